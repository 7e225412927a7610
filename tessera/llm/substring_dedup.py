"""Removal of long byte strings that occur more than once.

A byte goes if some string of `length` bytes covering it starts at two places of the corpus. Suffixes are sampled by
content: a string's anchor is the first of its smallest k-grams, so equal strings have their anchors at equal offsets, and
about one position in `length`/2 is one. Starts are not sorted one by one but induced from their anchors, in two rounds:

1. Starts with one anchor and offsets of one block form a node. Nodes are sorted by the string that all their starts share
   (shorter than `length`), then by the string that covers them all (longer), clipped at the text's ends. A node whose short
   string is unique holds no repeated start; one whose long string recurs holds only repeated ones.
2. Between the two, nodes are opened: their starts, and those of one node for each recurring long string beside them, are
   sorted by the strings of `length` bytes themselves.

Both sorts are Spark's external ones. A node or start is a row of a few numbers, so hot strings are never gathered; sorting
by windows streams them. Strings are compared by 64-bit hashes.

Besides, passages of `PASSAGE` words or more that stand elsewhere, too, are counted: the same search over the hashes of words
in place of bytes, in the same rounds. They are reported, not removed.

A null text is empty. Equal rows are places of their own. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.bytescan import Prefix, mix, slices, words
from tessera.llm.shared import stored

LENGTH = 400
GRAM = 32
BLOCK = 64
PASSAGE = 50  # words
_U = np.uint64


@dataclass(frozen=True)
class Unit:
    """What strings are made of: bytes, or words; how long they are, and the sizes of anchors and nodes."""

    length: int
    gram: int
    block: int
    words: bool = False

    def view(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return words(data, offsets) if self.words else (data, offsets)

    def place(self, within: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.code(within * (self.length // self.block + 2) + t)

    def code(self, number: np.ndarray) -> np.ndarray:
        """Numbers of words are negative, so both kinds fit into one column."""
        return -1 - number if self.words else number

    def own(self, codes: list[int] | None) -> np.ndarray:
        codes = np.array(codes or [], dtype=np.int64)
        return codes[codes < 0] if self.words else codes[codes >= 0]


PASSAGES = Unit(PASSAGE, 8, PASSAGE - 7, True)

PLACE_BITS = 26  # of a gram's key; the rest are leading bits of its hash
PART = 1 << 25


def anchors(prefix: Prefix, size: int, length: int, gram: int) -> np.ndarray:
    """The place of the anchor of the `length` bytes from each start, for `size` bytes; a text's own bytes decide alone."""
    out = []
    wide = length - gram + 1
    low = (_U(1) << _U(PLACE_BITS)) - _U(1)
    for begin in range(0, size - length + 1, PART):
        n = min(PART + wide - 1, size - gram + 1 - begin)
        at = np.arange(n, dtype=np.int64)
        # Smallest hash first, then the first place.
        keys = (prefix.of(begin + at, begin + at + gram) & ~low) | at.astype(_U)
        table = np.concatenate([keys, np.full(-n % wide, np.iinfo(_U).max, dtype=_U)]).reshape(-1, wide)
        head = np.minimum.accumulate(table, axis=1).ravel()
        tail = np.ascontiguousarray(np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1]).ravel()
        starts = n - wide + 1
        least = np.minimum(tail[:starts], head[wide - 1 : wide - 1 + starts])
        out.append((least & low).astype(np.int64) + begin)
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _starts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(prefix, starts, their anchors, their texts) of all strings of this length that lie within one text."""
    prefix = Prefix(data)
    places = anchors(prefix, len(data), length, gram)
    room = np.maximum(np.diff(offsets) - length + 1, 0)
    texts = np.repeat(np.arange(len(room)), room)
    starts = offsets[texts] + np.arange(len(texts)) - np.repeat(np.cumsum(room) - room, room)
    return prefix, starts, places[starts], texts


def _nodes(starts, places, texts, block: int):
    """Index of each node's first start; starts of one node are neighbours."""
    t = (places - starts) // block
    return t, np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (t[1:] != t[:-1]) | (texts[1:] != texts[:-1])])) if len(starts) else np.empty(0, dtype=np.int64)


NODES = "short long, long long, uid long, place long"


def _hash_nodes(units: list[Unit]):
    def run(batches):
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for row, _, data, offsets in slices(batch.column("text")):
                for unit in units:
                    yield from _unit_nodes(unit, *unit.view(data, offsets), uids[row:])

    return run


def _unit_nodes(unit: Unit, data: np.ndarray, offsets: np.ndarray, uids: np.ndarray):
    length, block = unit.length, unit.block
    prefix, starts, places, texts = _starts(data, offsets, length, unit.gram)
    t, heads = _nodes(starts, places, texts, block)
    if not len(heads):
        return
    t, p, k = t[heads], places[heads], texts[heads]
    low, high = offsets[k], offsets[k + 1]
    kind = _U(int(unit.words) << 40)
    # All starts of a node share this string ...
    a, b = np.maximum(p - t * block, low), np.minimum(p - (t + 1) * block + 1 + length, high)
    short = mix(prefix.of(a, np.maximum(a, b)) + mix(t.astype(_U) * _U(2) + kind))
    # ... and lie in this one; how far it is clipped belongs to it.
    a, b = p - (t + 1) * block + 1, p - t * block + length
    clip = np.maximum(low - a, 0) * (length + block) + np.maximum(b - high, 0)
    long = mix(prefix.of(np.maximum(a, low), np.minimum(b, high)) + mix(t.astype(_U) * _U(2) + _U(1) + kind + (clip.astype(_U) << _U(20))))
    yield pa.RecordBatch.from_arrays(
        [pa.array(short.view(np.int64)), pa.array(long.view(np.int64)), pa.array(uids[k]), pa.array(unit.place(p - low, t))], names=["short", "long", "uid", "place"],
    )


def _open(units: list[Unit]):
    """Hashes of the strings at the starts of the asked nodes."""

    def run(batches):
        for batch in batches:
            asked = batch.column("places").to_pylist()
            uids = batch.column("uid").to_numpy()
            for row, end, data, offsets in slices(batch.column("text")):
                for unit in units:
                    own = [unit.own(asked[k]) for k in range(row, end)]
                    if not any(map(len, own)):
                        continue
                    prefix, starts, texts, use = _asked_starts(unit, *unit.view(data, offsets), own)
                    s = starts[use]
                    string = mix(prefix.of(s, s + unit.length) + _U(unit.words))
                    within = unit.code(s - unit.view(data, offsets)[1][texts[use]])
                    yield pa.RecordBatch.from_arrays([pa.array(string.view(np.int64)), pa.array(uids[row + texts[use]]), pa.array(within)], names=["string", "uid", "start"])

    return run


def _asked_starts(unit: Unit, data: np.ndarray, offsets: np.ndarray, asked: list[np.ndarray]):
    """(prefix, starts, texts, index of the starts of the asked nodes)."""
    prefix, starts, places, texts = _starts(data, offsets, unit.length, unit.gram)
    place = unit.place(places - offsets[texts], (places - starts) // unit.block)
    bounds = np.searchsorted(texts, np.arange(len(offsets)))
    use = [a + np.flatnonzero(np.isin(place[a:b], asked[k])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
    return prefix, starts, texts, np.concatenate(use) if use else np.empty(0, dtype=np.int64)


def _covered(unit: Unit, data: np.ndarray, offsets: np.ndarray, nodes: list, single: list) -> list[np.ndarray]:
    """For each text, which of its bytes or words lie in a repeated string."""
    nodes, single = [unit.own(x) for x in nodes], [unit.own(x) for x in single]
    again = [[unit.code(x)] for x in single]
    if any(map(len, nodes)):
        _, starts, texts, use = _asked_starts(unit, data, offsets, nodes)
        bounds = np.searchsorted(texts[use], np.arange(len(offsets)))
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            again[k].append(starts[use[a:b]] - offsets[k])
    out = []
    for k, parts in enumerate(again):
        edge = np.zeros(int(offsets[k + 1] - offsets[k]) + 1, dtype=np.int64)
        at = np.concatenate(parts)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + unit.length, -1)
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def _runs(flags: np.ndarray) -> int:
    return int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())


DIGESTS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"]


def _cut(units: list[Unit], report: bool):
    """Texts without their repeated bytes, or digests of that."""

    def run(batches):
        for batch in batches:
            nodes, single = batch.column("nodes").to_pylist(), batch.column("starts").to_pylist()
            out = []
            for row, end, data, offsets in slices(batch.column("text")):
                gone, *passages = (_covered(unit, *unit.view(data, offsets), nodes[row:end], single[row:end]) for unit in units)
                for k in range(end - row):
                    own = data[offsets[k] : offsets[k + 1]]
                    left = own[~gone[k]].tobytes()
                    out.append((len(own), int(gone[k].sum()), _runs(gone[k]), hashlib.sha256(left).hexdigest(), *(_runs(p[k]) for p in passages)) if report else (left,))
            ids = batch.column("doc_id")
            columns = list(zip(*out)) if out else [()] * (len(DIGESTS) - 1 if report else 1)
            if report:
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=pa.string() if k == 3 else pa.int64()) for k, c in enumerate(columns))], names=DIGESTS)
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], type=pa.binary())], names=["doc_id", "kept"])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and uid. Equal rows share a uid and report their places each."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))


def repeated(rows: DataFrame, units: list[Unit]) -> DataFrame:
    """uid, nodes, starts: the nodes all of whose starts are repeated, and single repeated starts, of every text with any."""
    least = min(2 * u.length - 1 if u.words else u.length for u in units)
    hashed = rows.where(F.octet_length("text") >= least).select("uid", "text").mapInArrow(_hash_nodes(units), NODES)
    in_short = W.partitionBy("short").orderBy("long", "uid", "place")
    same = lambda f: F.coalesce(f("long").over(in_short) == F.col("long"), F.lit(False))
    dealt = hashed.repartition("short")
    marked = dealt.select("*", same(F.lag).alias("before"), same(F.lead).alias("after"), F.lag("uid").over(in_short).isNotNull().alias("has_lag"), F.lead("uid").over(in_short).isNotNull().alias("has_lead"))
    marked = marked.withColumn("again", F.col("before") | F.col("after")).where("has_lag or has_lead")
    single = F.max(~F.col("again")).over(W.partitionBy("short"))
    marked = stored(marked.select("uid", "place", "again", "before", single.alias("mixed")).where("again or mixed"), "nodes")

    # Nodes to open: those in doubt, and one for each recurring long string beside them.
    opened = marked.where("mixed and (not again or not before)").groupBy("uid").agg(F.collect_set("place").alias("places"))
    strings = rows.select("uid", "text").join(opened, "uid").mapInArrow(_open(units), "string long, uid long, start long")
    by_string = W.partitionBy("string").orderBy("uid", "start")
    starts = strings.select("uid", "start", (F.lag("uid").over(by_string).isNotNull() | F.lead("uid").over(by_string).isNotNull()).alias("again")).where("again")
    found = marked.where("again").select("uid", "place", F.lit(None).cast("long").alias("start")).unionByName(starts.select("uid", F.lit(None).cast("long").alias("place"), "start"))
    return found.groupBy("uid").agg(F.collect_set("place").alias("nodes"), F.collect_set("start").alias("starts"))


def _result(docs: DataFrame, units: list[Unit], report: bool, schema: str) -> DataFrame:
    rows = _numbered(docs)
    found = stored(repeated(rows, units), "repeats")
    return rows.join(found, "uid", "left").select("doc_id", "text", "nodes", "starts").mapInArrow(_cut(units, report), schema)


def digests(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, passages: Unit = PASSAGES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; n_passages: runs of words that stand elsewhere, too."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"
    return _result(docs, [Unit(length, gram, block), passages], True, schema)


def clean(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id and kept: the remaining bytes, which need not be whole characters."""
    return _result(docs, [Unit(length, gram, block)], False, "doc_id long, kept binary")
