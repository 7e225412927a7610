"""Batch search over the chunk table, its postings and its vectors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import truncate_lines
from tessera.operators import dense, hybrid, sparse

SCOPE = ["repo", "branch", "language"]


class Index(NamedTuple):
    """What a search reads: postings(chunk_id, hits) or (chunk_id, term_idx, w), vectors(chunk_id, dense), scope(chunk_id, filters)."""

    postings: DataFrame
    vectors: DataFrame
    scope: DataFrame


def with_scope(questions: DataFrame, fixed: dict[str, str] | None = None) -> DataFrame:
    """Questions with every scope column; a missing or empty one means no filter.  The tenant is required."""
    tenant = F.when(F.coalesce(F.col("user_id"), F.lit("")) == "", F.raise_error(F.lit("a tenant is required"))).otherwise(F.col("user_id"))
    columns = {"user_id": tenant}
    for name in [*SCOPE, "source_type"]:
        value = F.nullif(F.col(name), F.lit("")) if name in questions.columns else F.lit(None).cast("string")
        columns[name] = F.lit(fixed[name]) if fixed and name in fixed else value
    return questions.withColumns(columns)


def index_chunks(chunks: DataFrame, dim: int = 64) -> Index:
    """Postings, vectors and filter columns of a chunk table; write them next to it to search often."""
    return Index(sparse.term_vectors(chunks, "chunk_id"), dense.hash_embed(chunks, "chunk_id", dim),
                 chunks.select("chunk_id", "user_id", *SCOPE, "source_type"))


def search(questions: DataFrame, index: Index, k: int = K.DEFAULT_TOP_K, fixed: dict[str, str] | None = None,
           question_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): hybrid hits of a question batch.

    Filters apply inside both searches, before ranking.  `questions`: qid, user_id, query and optional
    repo, branch, language; `question_vectors`: qid, qdense, when a model of your own made the vectors.
    """
    asked = with_scope(questions, fixed)
    exact, optional = ["user_id"], [*SCOPE, "source_type"]
    limits = asked.select("qid", *exact, *optional)
    # Chunks that no question may see are left out before anything is scored; a question without a repository sees all of
    # its tenant's.
    seen = limits.select("user_id", F.col("repo").alias("_r")).distinct()
    visible = index.scope.join(seen.withColumnRenamed("user_id", "_u"), (F.col("user_id") == F.col("_u")) & (F.col("_r").isNull() | (F.col("repo") == F.col("_r"))), "left_semi")
    terms = sparse.postings(asked, "qid", text="query")
    found_sparse = sparse.sparse_top_k(index.postings, terms, k, chunk_scope=visible, question_scope=limits,
                                       exact=exact, optional=optional)
    if question_vectors is None:
        question_vectors = dense.hash_embed(asked, "qid", text="query").withColumnRenamed("dense", "qdense")
    found_dense = dense.dense_top_k(index.vectors.join(visible, "chunk_id"), limits.join(question_vectors, "qid"), k,
                                    exact=exact, optional=optional)
    return hybrid.fuse(found_dense, found_sparse, k)


def search_code(questions: DataFrame, index: Index, k: int = 5) -> DataFrame:
    return search(questions, index, k, fixed={"source_type": "code"})


def keep_issues(hits: DataFrame, chunks: DataFrame, state: str | None = None, limit: int | None = None) -> DataFrame:
    """Issue and pull-request hits among the ranked hits; with a limit, that many per question.

    The filter comes after ranking on purpose: a question whose best hits are code may keep none.
    """
    found = hits.join(chunks, "chunk_id").where(F.col("source_type").isin("issue", "pr"))
    if state is not None:
        found = found.where(F.col("state") == state)
    order = Window.partitionBy("qid").orderBy("rank")
    placed = found.withColumn("place", F.row_number().over(order) - 1)
    return placed if limit is None else placed.where(F.col("place") < limit)


def search_issues(questions: DataFrame, index: Index, chunks: DataFrame, state: str | None = None, k: int = K.DEFAULT_TOP_K) -> DataFrame:
    """The issues and pull requests among each question's k best hits."""
    return keep_issues(search(questions, index, k), chunks, state)


def file_outline(chunks: DataFrame) -> DataFrame:
    """(file, place, line): one outline line per definition of each file, in file order."""
    key = ["user_id", "repo", "branch", "file_path"]
    code = chunks.where((F.col("source_type") == "code") & F.col("chunk_type").isin("function", "method", "class"))
    start = F.coalesce(F.col("start_line"), F.lit(0))
    place = Window.partitionBy(*key).orderBy(start, "chunk_id")
    text = F.concat(F.lit("- "), F.col("chunk_type"), F.lit(": "), F.coalesce("signature", F.lit("None")), F.lit(" (Lines "),
                    F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    return code.select(*key, (F.row_number().over(place) - 1).alias("place"), text.alias("line"))


def file_text(chunks: DataFrame, shown_lines: int | None = None) -> DataFrame:
    """(file, text): the code of each file from its chunks; with `shown_lines`, cut for display after that many."""
    key = ["user_id", "repo", "branch", "file_path"]
    body = F.coalesce(F.nullif("full_body", F.lit("")), "text")
    parts = chunks.where(F.col("source_type") == "code").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("s"), "chunk_id", body.alias("b")))).alias("_p"))
    joined = F.array_join(F.col("_p.b"), "\n\n")
    if shown_lines is None:
        return parts.select(*key, joined.alias("text"))
    return parts.select(*key, truncate_lines(joined, shown_lines, f"... [TRUNCATED AT {shown_lines} LINES]").alias("text"))


def hit_text(source_type: Column, number: Column, state: Column, text: Column, max_chars: int | None = None) -> Column:
    """One issue or pull-request hit as shown to a reader; `max_chars` shortens its text."""
    head = F.when(source_type == "issue", "ISSUE #").otherwise("PR #")
    return F.concat(head, number.cast("string"), F.lit(" ("), state, F.lit(")\nCONTENT: "), text if max_chars is None else F.concat(F.substring(text, 1, max_chars), F.lit("...")), F.lit("\n"))
