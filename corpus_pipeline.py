"""From raw documents to packed training sequences: quality, repeated lines, near copies, benchmark leaks, packing.

Every stage takes and returns a table; each result is written as Parquet and read again as the next stage's documents. All
but the last return the columns of `documents`, with n_chars brought up to date where a text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, line_dedup, near_dedup, packing, quality, queries
from tessera.llm.shared import stored

ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL; tests/llm compares each stage with brute force


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble scores below one half. Rows equal in id and text share their fate."""
    model = queries.quality_model(spark, docs, sf_dir)
    scored = quality.statistics(docs.select(*(F.col(c).alias(f"_{c}") for c in docs.columns), F.coalesce("text", F.lit("")).alias("text")))
    return scored.where(quality.probability(model) >= 0.5).select(*(F.col(f"_{c}").alias(c) for c in docs.columns))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand, equal or within two edits, earlier in the corpus."""
    out = line_dedup.clean(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.keep_one(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold three quarters of a benchmark item."""
    return decontamination.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences."""
    return packing.pack(docs, queries.tokenizer_path(), end_id=2)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", no_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
