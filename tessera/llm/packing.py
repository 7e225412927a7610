"""Harmonic packing of token sequences.

Class j holds pieces of at most capacity/j tokens, and each of its bins takes exactly j of them, so a piece's bin follows
from its number within the class alone: tasks number their own pieces, and sums over (task, class) counts place them.
Plain harmonic classes waste up to half a bin, so a document's rest is first cut: while a rest would leave more than
`slack` tokens of its place empty, a piece that fills a place of the next class goes off. Only the last, unfilled bin of
each class is left; those (at most one per class) are joined by first fit.

A null text is empty (its document is the end id alone). Repeated rows are documents of their own; with equal ids they
share `doc_id`. A null id is kept. Other columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import stored
from tessera.llm.tokens import encoder, packed

CAPACITY = 4096
SLACK = 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, part long, number long"


@lru_cache(maxsize=None)
def cuts(rest: int, capacity: int = CAPACITY, slack: int = SLACK) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a rest below the capacity, longest first."""
    if not rest:
        return ()
    j = capacity // rest
    if capacity // j - rest <= slack:
        return ((rest, j),)
    first = capacity // (j + 1)
    return ((first, j + 1), *cuts(rest - first, capacity, slack))


def _pieces(path: str, end_id: int, capacity: int, slack: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        part, numbers = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys, rows, out = batch.column("doc_id"), [], []
            for row, ids in packed(batch.column("text"), path):
                ids += end
                total, start = len(ids) // 4, 0
                for length, j in (*((capacity, 1),) * (total // capacity), *cuts(total % capacity, capacity, slack)):
                    number = numbers.get(j, 0)
                    numbers[j] = number + 1
                    rows.append(row)
                    out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, j, part, number))
                    start += length
            if out:
                columns = np.array(out, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=[x.split()[0] for x in PIECES.split(", ")])
        encoder(path).forget()  # a worker may go on with other work

    return run


def _last_bins(sizes: list[tuple[int, int]], capacity: int) -> dict[int, tuple[int, int]]:
    """class -> (bin, offset) of each class's unfilled bin; at most one per class, so this is small."""
    free, placed = [], {}
    for j, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = next((k for k, f in enumerate(free) if f >= size), len(free))
        if k == len(free):
            free.append(capacity)
        placed[j] = (k, capacity - free[k])
        free[k] -= size
    return placed


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of `docs` (doc_id, text).

    The numbering of classes and their counts is collected: at most `capacity` rows, whatever the input.
    """
    spark = docs.sparkSession
    pieces = stored(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, end_id, capacity, slack), PIECES),
        "pieces",
    )
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(starts, ["class", "part"]).withColumn("rank", F.col("first") + F.col("number")).drop("first", "number", "part")

    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    bases, bins = {}, 0
    for j in sorted(totals):
        bases[j], bins = bins, bins + totals[j] // j
    full = {j: n // j for j, n in totals.items()}
    table = spark.createDataFrame([(j, bases[j], full[j]) for j in totals], "class long, base long, full long")
    ranked = ranked.join(F.broadcast(table), "class").withColumn("bin", F.expr("rank div class"))
    left = {r["class"]: r["size"] for r in ranked.where("bin >= full").groupBy("class").agg(F.sum("length").alias("size")).collect()}
    placed = _last_bins(list(left.items()), capacity)
    last = spark.createDataFrame([(j, bins + k, offset) for j, (k, offset) in placed.items()], "class long, last long, shift long")
    in_bin = W.partitionBy("class", "bin").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    rest = F.col("bin") >= F.col("full")
    return ranked.join(F.broadcast(last), "class", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(rest, F.col("last")).otherwise(F.col("base") + F.col("bin")).alias("sequence_id"),
        (F.coalesce(F.sum("length").over(in_bin), F.lit(0)) + F.when(rest, F.col("shift")).otherwise(0)).alias("offset"),
    )
