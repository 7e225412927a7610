"""Benchmark decontamination: MinHash containment search for short items inside long documents.

An item's sketch is the smallest hashes of its word shingles. Items are parted by size: all items of a class share a sketch
length of one more than the shingles that the largest item of the class may miss. Whoever holds the asked share of an
item's shingles misses fewer than that, so it holds at least one of the sketch: no match is lost, however long the
document, and a document needs no sketch of its own. Hits are verified by exact containment over the words themselves.

Items come in blocks of bounded size, one pass over the documents each, so that what is broadcast does not grow.

Words are lower-cased (A-Z) and cut at ASCII white space. An item of fewer than `width` words is one shingle, its whole
sequence. Null or empty items match nothing; null or empty documents hold nothing. Repeated items and documents match each
by itself; null ids are carried. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import LOWER, shingles, slices, words

WIDTH = 5
PERCENT = 75
BLOCK_BYTES = 8 << 20  # text of the items that are broadcast at once
SCHEMA = "doc_id long, item_id long, n_found long, n_shingles long"


def _split(text: bytes) -> list[bytes]:
    return LOWER[np.frombuffer(text, dtype=np.uint8)].tobytes().split()


def _runs(tokens: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    width = min(width, len(tokens))
    return {tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1)} if width else set()


class Items:
    """One block of items: sketches as a sorted array of hashes with the items that hold each."""

    def __init__(self, rows: list[tuple[int | None, str]], width: int, percent: int):
        self.ids, self.sets, self.width, self.percent = [], [], width, percent
        widths, sketches = [], []
        by_class: dict[int, list[int]] = defaultdict(list)
        all_hashes = []
        for item_id, text in rows:
            tokens = _split((text or "").encode())
            runs = _runs(tokens, width)
            if not runs:
                continue
            data = np.frombuffer(b" ".join(tokens), dtype=np.uint8)
            hashes = np.unique(shingles(words(data, np.array([0, len(data)]))[0], width))
            by_class[len(runs).bit_length()].append(len(self.ids))
            self.ids.append(item_id)
            self.sets.append(runs)
            widths.append(min(width, len(tokens)))
            all_hashes.append(hashes)
        for members in by_class.values():
            may_miss = max(len(self.sets[k]) - self.needed(len(self.sets[k])) for k in members)
            sketches += [(h, k) for k in members for h in all_hashes[k][: may_miss + 1].tolist()]
        sketches.sort()
        self.hashes = np.array(sorted({h for h, _ in sketches}), dtype=np.uint64)
        self.holders: dict[int, list[int]] = defaultdict(list)
        for h, k in sketches:
            self.holders[h].append(k)
        self.widths = sorted(set(widths))

    def needed(self, size: int) -> int:
        """Least number of shingles for the asked share of `size`."""
        return -(-self.percent * size // 100)

    def search(self, batches):
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for row, _, data, offsets in slices(batch.column("text")):
                hashes, first = words(data, offsets)
                hits: dict[int, set[int]] = defaultdict(set)
                for width in self.widths:
                    runs = shingles(hashes, width) if len(hashes) >= width else hashes[:0]
                    at = np.minimum(np.searchsorted(self.hashes, runs), len(self.hashes) - 1)
                    where = np.flatnonzero(self.hashes[at] == runs)
                    for doc, p in zip((np.searchsorted(first, where, side="right") - 1).tolist(), where.tolist()):
                        if p + width <= first[doc + 1]:
                            hits[doc].update(self.holders[int(runs[p])])
                for doc, items in hits.items():
                    tokens = _split(data[offsets[doc] : offsets[doc + 1]].tobytes())
                    of = {w: _runs(tokens, w) for w in {len(next(iter(self.sets[k]))) for k in items} if w <= len(tokens)}
                    for k in sorted(items):
                        runs = self.sets[k]
                        n = len(runs & of.get(len(next(iter(runs))), set()))
                        if n >= self.needed(len(runs)):
                            found.append((row + doc, k, n))
            if found:
                rows, items, counts = map(list, zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array([self.ids[k] for k in items], type=pa.int64()), pa.array(counts, type=pa.int64()), pa.array([len(self.sets[k]) for k in items], type=pa.int64())],
                    names=["doc_id", "item_id", "n_found", "n_shingles"],
                )


def contained(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_found, n_shingles where a document holds `percent` per cent of an item's distinct shingles."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    # Blocks are cut by a hash, and large ones again, so none holds much more than block_bytes.
    parts = [_part(spark, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), width, percent, rows) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _part(spark, block: DataFrame, width: int, percent: int, rows: DataFrame) -> DataFrame:
    held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])

    def run(batches):
        index = Items(held.value, width, percent)
        if index.ids:
            yield from index.search(batches)
        else:
            for _ in batches:
                pass

    return rows.mapInArrow(run, SCHEMA)


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id and item_id of every match, with how many of the item's distinct shingles were found; equal rows count once."""
    return contained(docs, items, **options).distinct()


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a match. A row's text decides, told by its hash, so null and repeated ids are no matter."""
    th = F.xxhash64(F.col("text").cast("string"))
    bad = contained(docs.select(th.alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias("_th")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), th.alias("_own"))
    return rows.join(bad, F.col("_own") == F.col("_th"), "left_anti").select("_row.*")
