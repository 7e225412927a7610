"""Token ids as ORC files.

A document is a row; its ids are an integer list, which ORC stores by run-length encoding. Files hold ascending ranges of
document ids, stripes can be read by different tasks, and row indexes and Bloom filters on the id let a reader skip the
rest of a file. A null text counts as empty, so its row holds the end id alone. Rows with equal ids keep all their copies,
in the order of a hash of the text; a null id comes first. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.tokens import packed

SCHEMA = "doc_id long, part long, part_start long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, keys, done = [], batch.column("doc_id"), 0
            for _, own in packed(batch.column("text"), path):
                ids.append(np.frombuffer(own + end, dtype="<i4"))
                if len(ids) >= 1000:
                    out, start = _rows(keys, done, ids, part, start)
                    yield out
                    done, ids = done + len(ids), []
            if ids:
                out, start = _rows(keys, done, ids, part, start)
                yield out

    return run


def _rows(keys: pa.Array, done: int, ids: list[np.ndarray], part: int, start: int) -> tuple[pa.RecordBatch, int]:
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    ends = np.cumsum(sizes)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(ids)))
    return pa.RecordBatch.from_arrays(
        [keys.slice(done, len(ids)), pa.array(np.full(len(ids), part, dtype=np.int64)), pa.array(start + ends - sizes), pa.array(sizes), lists],
        names=["doc_id", "part", "part_start", "n_tokens", "ids"],
    ), start + int(ends[-1])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, files: int | None = None, stripe_bytes: int = 64 << 20, stride: int = 10_000, false_positives: float = 0.01) -> None:
    """Encodes `docs` (doc_id, text), appends `end_id` to each and writes ascending ranges of doc_id.

    The text moves once, before encoding; ranges are cut by (doc_id, hash of the text), so that no one id fills a task.
    `files`: how many ranges, by default the session's shuffle partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    (
        rows.sortWithinPartitions(*keys, "text")
        .mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(false_positives))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document.

    Files hold starts within their range; the ranges' own starts are sums over one row per range, so what is broadcast is 16
    bytes for each file.
    """
    rows = spark.read.schema(SCHEMA).orc(folder)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id: stripes and row groups whose statistics or Bloom filter exclude the ids are not read."""
    return spark.read.schema(SCHEMA).orc(folder).where(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "ids")


def _crc(batches):
    for batch in batches:
        lists = batch.column("ids")
        offsets = np.asarray(lists.offsets)
        values = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, type=pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC of the ids as little-endian unsigned 32-bit integers."""
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
