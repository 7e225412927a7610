"""Line deduplication across documents by a segment-partition edit join.

A line goes if an equal line, or one within `edits` byte edits, stands earlier in the corpus (by doc_id, text hash, line
number). For the near ones a line is split into edits + 1 segments: two lines within that many edits share one of the
shorter one's segments, at a place that differs by no more than the edits before and after it allow. So each line puts its
segments into an index by (length, segment number, content) and probes the substrings that may match for each shorter
length. Meetings are filtered by a signature (parities of byte values: an edit changes at most two) and verified by a banded
bit-parallel edit distance. Near matches are for lines of at least `least` bytes on both sides; shorter lines go only if equal.

Blank lines stay. Lines end at a line feed. Null texts stay null; documents may become empty. Null ids come last. Rows equal
in id and text are treated alike, so their lines stay in each. Extra columns are carried. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import SPACE, Prefix, mix, slices
from tessera.llm.shared import stored

EDITS = 2
LEAST = 20
_U = np.uint64
LINES = "doc_id long, th long, line int, l1 long, l2 long, size int"


def _bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all lines, and each text's first line number. An empty text is one empty line."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    first = np.searchsorted(feeds, offsets[:-1]) + np.arange(len(offsets) - 1)
    # A text's first line starts at its offset; equal offsets (empty texts) keep their order.
    per = np.diff(np.append(first, len(starts)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = first + per - 1
    ends[last] = offsets[1:]
    return starts, ends, first, per


def _occurrences(batches):
    for batch in batches:
        out = []
        ids, hashes = batch.column("doc_id"), batch.column("th")
        for row, _, data, offsets in slices(batch.column("text")):
            starts, ends, first, per = _bounds(data, offsets)
            blank = np.add.reduceat(np.append(~SPACE[data], 0).astype(np.int64), np.minimum(starts, len(data))) if len(starts) else starts
            whole = data.tobytes()
            doc = np.repeat(np.arange(len(per)), per)
            number = np.arange(len(starts)) - first[doc]
            use = np.flatnonzero((ends > starts) & (blank > 0))
            digests = b"".join(xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(starts[use].tolist(), ends[use].tolist()))
            both = np.frombuffer(digests, dtype=">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(row + doc[use])
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), hashes.take(rows), pa.array(number[use].astype(np.int32)), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array((ends - starts)[use].astype(np.int32))],
                names=["doc_id", "th", "line", "l1", "l2", "size"],
            )


def _segments(sizes: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment k of lines of these lengths: the last ones are longer by one where it doesn't divide."""
    short = sizes // (edits + 1)
    longer = sizes - short * (edits + 1)
    from_end = edits + 1 - longer  # segments before this one are short
    return k * short + np.maximum(0, k - from_end), short + (k >= from_end)


def signature(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Parity of the count of each byte value modulo 32, as bits."""
    flips = np.zeros(len(data) + 1, dtype=np.uint32)
    np.bitwise_xor.accumulate(np.uint32(1) << (data & 31).astype(np.uint32), out=flips[1:])
    return flips[ends] ^ flips[starts]


PACKED = "shard int, indexed binary, probes binary"
# Within a shard 32 bits of the key are enough: a chance meeting is only a pair more to verify. So are 32 parities.
_ENTRY = np.dtype([("key", "<u4"), ("id", "<u8"), ("sig", "<u4")])


def _keys(edits: int, least: int, shards: int):
    """Index entries and probes of the distinct long lines of each slice, packed by shard."""

    def entries(keys, ids, sigs):
        keys = np.concatenate(keys)
        out = np.empty(len(keys), dtype=_ENTRY)
        out["key"], out["id"], out["sig"] = keys & _U(0xFFFFFFFF), np.concatenate(ids), np.concatenate(sigs)
        return out, (keys >> _U(32)) * _U(shards) >> _U(32)

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                starts, ends, _, _ = _bounds(data, offsets)
                use = np.flatnonzero(ends - starts >= least)
                if not len(use):
                    continue
                starts, ends = starts[use], ends[use]
                prefix = Prefix(data)
                _, one = np.unique(prefix.of(starts, ends), return_index=True)
                starts, ends = starts[one], ends[one]
                sizes = ends - starts
                whole = data.tobytes()
                ids = np.array([int.from_bytes(xxhash.xxh3_128_digest(whole[a:b])[:8], "big") for a, b in zip(starts.tolist(), ends.tolist())], dtype=_U)
                sigs = signature(data, starts, ends)

                def key(length, k, hashes):
                    return mix(hashes + mix(length.astype(_U) * _U(edits + 1) + _U(k)))

                index, probes = ([], [], []), ([], [], [])
                for k in range(edits + 1):
                    at, size = _segments(sizes, k, edits)
                    for part, x in zip(index, (key(sizes, k, prefix.of(starts + at, starts + at + size)), ids, sigs)):
                        part.append(x)
                    for gap in range(edits + 1):  # lines shorter by `gap`
                        at, size = _segments(sizes - gap, k, edits)
                        # Multi-match-aware places: k edits before the segment and edits - k after it suffice.
                        low, high = max(-k, gap - (edits - k)), min(k, gap + (edits - k))
                        for shift in range(low, high + 1):
                            ok = np.flatnonzero((at + shift >= 0) & (at + shift + size <= sizes) & (sizes - gap >= least))
                            a = starts[ok] + at[ok] + shift
                            for part, x in zip(probes, (key(sizes[ok] - gap, k, prefix.of(a, a + size[ok])), ids[ok], sigs[ok])):
                                part.append(x)
                sides = []
                for part in (index, probes):
                    rows, shard = entries(*part)
                    order = np.argsort(shard, kind="stable")
                    sides.append((rows[order], np.searchsorted(shard[order], np.arange(shards + 1, dtype=_U)).tolist()))
                (x, xb), (y, yb) = sides
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(shards, dtype=np.int32)), pa.array([x[a:b].tobytes() for a, b in zip(xb, xb[1:])]), pa.array([y[a:b].tobytes() for a, b in zip(yb, yb[1:])])],
                    names=["shard", "indexed", "probes"],
                )

    return run


def _met(index: np.ndarray, probes: np.ndarray, edits: int):
    """Pairs of ids that meet under a key with close signatures, in bounded blocks."""
    index, probes = (x[np.argsort(x["key"], kind="stable")] for x in (index, probes))
    low = np.searchsorted(index["key"], probes["key"], side="left")
    count = np.searchsorted(index["key"], probes["key"], side="right") - low
    hit = np.flatnonzero(count)
    if not len(hit):
        return
    low, count, probes = low[hit], count[hit], probes[hit]
    ends = np.cumsum(count)
    done = 0
    while done < len(hit):
        # A probe with more partners than a block holds is a block of its own.
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 22), side="right")))
        n = count[done:stop]
        who = np.repeat(np.arange(done, stop), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[done:stop], n)
        close = np.bitwise_count(probes["sig"][who] ^ index["sig"][at]) <= 2 * edits
        close &= probes["id"][who] != index["id"][at]
        a, b = probes["id"][who[close]], index["id"][at[close]]
        yield np.minimum(a, b), np.maximum(a, b)
        done = stop


def _pairs(edits: int):
    def run(batches):
        now, index, probes = None, [], []

        def done():
            if index and any(map(len, index)) and any(map(len, probes)):
                # The same line comes from many tasks; once is enough.
                sides = [np.unique(np.frombuffer(b"".join(x), dtype=_ENTRY).view("V16")).view(_ENTRY) for x in (index, probes)]
                for a, b in _met(*sides, edits):
                    both = np.unique(np.stack([a, b], axis=1), axis=0)
                    if len(both):
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, j]).view(np.int64)) for j in (0, 1)], names=["a", "b"])

        for batch in batches:
            for s, x, y in zip(*(batch.column(c).to_pylist() for c in ("shard", "indexed", "probes"))):
                if s != now:
                    yield from done()
                    now, index, probes = s, [], []
                index.append(x)
                probes.append(y)
        yield from done()

    return run


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance is at most `most`: a diagonal band of 2 * most + 1 cells as bits of one integer."""
    if abs(len(a) - len(b)) > most:
        return False
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= most
    # reach[e]: bit most + d is set if e edits reach the diagonal d after the rows read so far.
    width = 2 * most + 1
    full = (1 << width) - 1
    reach = [0] * (most + 1)
    row = 1 << most
    for e in range(most + 1):
        reach[e] = row
        row = (row | row << 1) & full
    where: dict[int, int] = {}
    for j, c in enumerate(b[: most]):
        where[c] = where.get(c, 0) | 1 << (j + most + 1)
    for i, c in enumerate(a):
        # Bit most + d of `same` tells whether b[i + d] equals a[i].
        entering = i + most
        if entering < len(b):
            x = b[entering]
            where[x] = where.get(x, 0) | 1 << (width + i)
        same = (where.get(c, 0) >> (i + 1)) & full
        inside = full & ~((1 << max(0, most - i - 1)) - 1)
        over = i + 1 + most - len(b)
        if over > 0:
            inside &= (1 << max(0, width - over)) - 1
        new = []
        for e in range(most + 1):
            now = reach[e] & same
            if e:
                now |= reach[e - 1] | reach[e - 1] >> 1  # substitution, deletion from a
                now |= new[e - 1] << 1  # insertion
            new.append(now & inside)
        reach = new
        if not reach[most]:
            return False
    return bool(reach[most] >> (most + len(b) - len(a)) & 1)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, dtype=np.uint8, count=n), np.frombuffer(b, dtype=np.uint8, count=n)
    return int((x != y).argmax())


def _wanted(batches):
    """Lines of a text by number."""
    for batch in batches:
        keys, lines = [], []
        for text, numbers, ids in zip(batch.column("text").to_pylist(), batch.column("numbers").to_pylist(), batch.column("ids").to_pylist()):
            parts = text.encode().split(b"\n")
            keys += ids
            lines += [parts[k] for k in numbers]
        yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(lines, type=pa.binary())], names=["id", "line"])


def _close(edits: int):
    def run(batches):
        for batch in batches:
            stays = pa.array([within(x, y, edits) for x, y in zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist())], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(stays) for c in ("a", "b")], names=["a", "b"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("th"), F.col("text").cast("string").alias("text"))


def dropped(docs: DataFrame, *, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, th (hash of the text), exact, near: the numbers of the lines that go, for every document with any."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _keyed(docs).where("text is not null")
    seen = stored(texts.mapInArrow(_occurrences, LINES), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "line")
    firsts = stored(seen.groupBy("l1", "l2").agg(F.min(place).alias("first"), F.max("size").alias("size")), "firsts")

    packed = texts.select("text").mapInArrow(_keys(edits, least, shards), PACKED).repartition(shards, "shard").sortWithinPartitions("shard")
    pairs = stored(packed.mapInArrow(_pairs(edits), "a long, b long").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("l1")).unionByName(pairs.select(F.col("b").alias("l1"))).distinct()
    wanted = firsts.where(F.col("size") >= least).join(ids, "l1").groupBy(F.col("first.doc_id").alias("d"), F.col("first.th").alias("t")).agg(F.collect_list("first.line").alias("numbers"), F.collect_list("l1").alias("ids"))
    lines = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("text", "numbers", "ids")
    lines = stored(lines.mapInArrow(_wanted, "id long, line binary").distinct(), "lines")
    side = lambda c: lines.select(F.col("id").alias(c), F.col("line").alias(f"l{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "la", "lb").mapInArrow(_close(edits), "a long, b long")
    at = lambda c: firsts.select(F.col("l1").alias(c), F.col("first").alias(f"f{c}"))
    later = near.join(at("a"), "a").join(at("b"), "b").select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("l1")).distinct()

    judged = seen.join(firsts.select("l1", "l2", "first"), ["l1", "l2"]).join(later.withColumn("near", F.lit(True)), "l1", "left")
    again = (F.col("th") != F.col("first.th")) | (F.col("line") != F.col("first.line")) | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    judged = judged.select("doc_id", "th", "line", again.alias("again"), F.coalesce("near", F.lit(False)).alias("near")).where("again or near")
    return judged.groupBy("doc_id", "th").agg(
        F.collect_set(F.when(F.col("again"), F.col("line"))).alias("exact"), F.collect_set(F.when(~F.col("again"), F.col("line"))).alias("near"),
    )


def _without(text: str, gone: set[int]) -> str:
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def _rebuilt(names: list[str]):
    def run(batches):
        for batch in batches:
            exact, near = batch.column("exact").to_pylist(), batch.column("near").to_pylist()
            texts = [t if t is None or not (x or y) else _without(t, {*(x or ()), *(y or ())}) for t, x, y in zip(batch.column("text").to_pylist(), exact, near)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, type=batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names], names=names)

    return run


def _judged(docs: DataFrame, gone: DataFrame) -> DataFrame:
    rows = docs.withColumn("text", F.col("text").cast("string"))
    th = F.coalesce(F.xxhash64(rows["text"]), F.lit(0))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "exact", "near")
    return rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (th == F.col("_t")), "left")


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents, in their own columns, without the lines that stand earlier elsewhere."""
    clash = [c for c in docs.columns if c in ("exact", "near", "_d", "_t")]
    rows = docs.withColumnsRenamed({c: f"own_{c}" for c in clash})
    names = rows.columns
    out = _judged(rows, dropped(docs.select("doc_id", "text"), **options)).select(*names, "exact", "near")
    return out.mapInArrow(_rebuilt(names), out.select(*names).schema).withColumnsRenamed({f"own_{c}": c for c in clash})


def _digests(batches):
    for batch in batches:
        rows = []
        for text, x, y in zip(*(batch.column(c).to_pylist() for c in ("text", "exact", "near"))):
            x, y = x or [], y or []
            n = 0 if text is None else text.count("\n") + 1
            rows.append((n, len(x), len(y), hashlib.sha256(_without(text or "", {*x, *y}).encode()).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, type=pa.int64()) for c in columns[:3]), pa.array(columns[3], type=pa.string())], names=["doc_id", "n_lines", "n_exact", "n_near", "kept_sha256"])


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_exact and n_near (lines that went), kept_sha256 of the remaining text, for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _judged(rows, dropped(rows, **options)).select("doc_id", "text", "exact", "near").mapInArrow(_digests, "doc_id long, n_lines long, n_exact long, n_near long, kept_sha256 string")
