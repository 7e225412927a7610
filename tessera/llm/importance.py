"""Resampling towards a target: documents are drawn with weights from hashed n-gram counts of a corpus and of a target.

A text's words are joined by one space and scanned once; the running CRC-32 register is kept at every word's start and
end. The CRC of any n-gram then needs no second look at its bytes: with R the register at a place and Z the linear map that
one zero byte applies to a register, the register of the bytes from a to b alone is R(b) xor Z^(b-a) R(a), and the initial
and final complements of CRC-32 are a term of the length alone. Z^n is applied by the powers Z^(2^k) in the binary form of
n, each a sum over GF(2) that four tables of 256 entries hold. The scan itself steps many stretches of `LANE` bytes at once;
each stretch's true start is the sum of the ends before it, shifted likewise.

Counts are summed per task into at most one row per bucket, so a frequent n-gram never moves as rows. What goes to every task
are the gains of the buckets: 8 bytes for each, whatever the input. Places are dealt by a range sort of (score, id) and counts
per range, so no task sees the whole order.

A null text has no words, a text without words no features and weight 0. Repeated rows are documents of their own, with a
place each; a null id counts as empty in the draw and comes after all others among equal scores. Other columns are ignored.
An empty corpus gives no rows, an empty target leaves all gains to the corpus counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.bytescan import LOWER, slices
from tessera.llm.shared import stored

BUCKETS = 10_000
LONGEST = 2  # words of an n-gram
LANE = 256
POLYNOMIAL = 0xEDB88320  # of CRC-32, low bit first
_U = np.uint32
_ONES = _U(0xFFFFFFFF)

WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_table() -> np.ndarray:
    """The register after one byte, from an empty register."""
    out = np.arange(256, dtype=_U)
    for _ in range(8):
        out = (out >> _U(1)) ^ np.where(out & _U(1), _U(POLYNOMIAL), _U(0))
    return out


STEP = _byte_table()


def _sliced(images: np.ndarray) -> np.ndarray:
    """Four tables of 256 entries for the linear map that sends bit k to images[k]."""
    values = np.arange(256)
    return np.stack([
        np.bitwise_xor.reduce(np.where(values[:, None] >> np.arange(8) & 1, images[8 * k : 8 * k + 8], _U(0)), axis=1).astype(_U) for k in range(4)
    ])


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & _U(255)] ^ table[1][x >> _U(8) & _U(255)] ^ table[2][x >> _U(16) & _U(255)] ^ table[3][x >> _U(24)]


class Shift:
    """Z^n, by the binary form of n."""

    def __init__(self):
        bits = _U(1) << np.arange(32, dtype=_U)
        self.powers = [_sliced(STEP[bits & _U(255)] ^ (bits >> _U(8)))]

    def power(self, k: int) -> np.ndarray:
        """Tables of Z^(2^k)."""
        bits = _U(1) << np.arange(32, dtype=_U)
        while len(self.powers) <= k:
            last = self.powers[-1]
            self.powers.append(_sliced(_apply(last, _apply(last, bits))))
        return self.powers[k]

    def by(self, registers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Every register after so many zero bytes."""
        out = registers.copy()
        for k in range(int(sizes.max(initial=0)).bit_length()):
            rows = np.flatnonzero(sizes >> k & 1)
            out[rows] = _apply(self.power(k), out[rows])
        return out


SHIFT = Shift()


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, lower-cased and each with one space behind; starts, ends and each text's first word."""
    low = LOWER[data]
    inside = WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(sizes), 32, dtype=np.uint8)
    kept = np.flatnonzero(inside)
    out[kept - np.repeat(starts - to, sizes)] = low[kept]
    return out, to, to + sizes, np.searchsorted(starts, offsets)


def running(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The register, from an empty one, before each of the ascending places."""
    lanes = len(data) // LANE + 1
    table = np.zeros(lanes * LANE, dtype=np.uint8)
    table[: len(data)] = data
    table = np.ascontiguousarray(table.reshape(lanes, LANE).T)
    local = np.empty((LANE, lanes), dtype=_U)
    now = np.zeros(lanes, dtype=_U)
    for k in range(LANE):
        local[k] = now
        now = STEP[(now ^ table[k]) & _U(255)] ^ (now >> _U(8))
    # A lane's start is the sum of all ends before it, each shifted by the lanes between: prefix sums by doubling.
    total, step, k = now, 1, LANE.bit_length() - 1
    while step < lanes:
        total = total.copy()
        total[step:] ^= _apply(SHIFT.power(k), total[:-step])
        step, k = 2 * step, k + 1
    begin = np.concatenate([np.zeros(1, dtype=_U), total[:-1]])
    lane, at = places // LANE, places % LANE
    return local[at, lane] ^ SHIFT.by(begin[lane], at)


def crcs(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST):
    """(CRC-32, text) of all runs of 1 to `longest` words, in parts by length."""
    clean, starts, ends, first = normalised(data, offsets)
    n = len(starts)
    if not n:
        return
    registers = running(clean, np.stack([starts, ends], axis=1).ravel())
    at_start, at_end = registers[::2], registers[1::2]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for width in range(1, min(longest, n) + 1):
        own = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
        sizes = ends[own + width - 1] - starts[own]
        # The complement before the first byte is shifted along with the register that is taken off.
        yield at_end[own + width - 1] ^ SHIFT.by(at_start[own] ^ _ONES, sizes) ^ _ONES, text[own]


def _counts(buckets: int, longest: int):
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                for values, _ in crcs(data, offsets, longest):
                    total += np.bincount(values % _U(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return run


def counts(texts: DataFrame, *, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: how many n-grams of all texts fall into each bucket that has any."""
    own = texts.select(F.col("text").cast("string")).mapInArrow(_counts(buckets, longest), "bucket long, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, longest: int = LONGEST, scale: int = 1000) -> np.ndarray:
    """Each bucket's floor(scale * ln of how much more often the target falls into it), with one more of each counted."""
    spark = docs.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket")
    for name, table in (("s", docs), ("t", target)):
        both = both.join(counts(table, buckets=buckets, longest=longest).withColumnRenamed("n", name), "bucket", "left")
    both = stored(both.select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in "st")), "buckets")
    s, t = both.agg(F.sum("s"), F.sum("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(t + buckets))
    rows = both.select("bucket", F.floor(F.lit(float(scale)) * F.log(up / down)).cast("long").alias("gain")).collect()  # `buckets` rows
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def _weights(gain: np.ndarray, longest: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, end, data, offsets in slices(batch.column("text")):
                n = end - row
                features, total, words = (np.zeros(n, dtype=np.int64) for _ in range(3))
                for width, (values, texts) in enumerate(crcs(data, offsets, longest)):
                    own = np.bincount(texts, minlength=n)
                    features += own
                    ends = np.cumsum(own)
                    sums = np.concatenate([[0], np.cumsum(gain[values % _U(len(gain))])])
                    total += sums[ends] - sums[ends - own]
                    if not width:
                        words = own
                weight = total // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: np.ndarray, *, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and the floored mean gain of every document's n-grams (none: 0)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_weights(gain, longest), "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, scale: int = 1000):
    """floor(-scale * ln(-ln u)), u from the first 32 bits of sha256("seed:doc_id"): the draw's Gumbel variable."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32))))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, least: int = 20, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document.

    Of the documents with at least `least` words, `percent` of a hundred with the highest scores are drawn, without
    replacement: weight plus Gumbel noise in place of repeated draws. Equal scores go by the smaller id.
    """
    gain = gains(docs, target, buckets=buckets, longest=longest)
    scored = weights(docs, gain, longest=longest).withColumn("score", F.col("weight") + noise(seed))
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    scored = scored.withColumn("open", F.col("n_words") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
    scored = stored(scored.withColumn("place", F.monotonically_increasing_id()), "scored")
    part = F.shiftright("place", 33)
    sizes = scored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row for each task
    drawn = (sizes.agg(F.sum("n_open")).first()[0] or 0) * percent // 100
    rank = F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return scored.withColumn("part", part).join(F.broadcast(bases), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("open") & (rank <= drawn), rank).alias("rank"),
    )


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, with all their columns; rows that share an id share their fate."""
    ranked = resample(docs.select("doc_id", "text"), target, **how).where("rank is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_own"))
    return rows.join(ranked, F.col("_own").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")
