"""The trie of all conversations' beginnings, from sorted conversations and their common prefixes.

A conversation becomes an array of turn keys (16 bytes of (role, text) each) and running word counts; texts never move. The
arrays are range-sorted over all tasks. A prefix of d turns then is an interval of neighbours, and all that is asked about
it is a sum over its interval. Let n be a conversation's turns, l what it shares with the one before, and w(k) the words of
its first k turns:

- a node starts where l < d <= n, so its children are counted where they start;
- a childless node ends where the next conversation shares less than n, so childless nodes below are a sum too;
- every member but a node's first saves the node's last turn, so a subtree saves the sum of w(l) - w(d - 1) over the interval's
  conversations but the first.

Intervals are found a segment of at most `SEGMENT` conversations at a time: a sparse table holds the minima of l over all
spans of 2^k conversations, and every candidate prefix searches its left and right end in it by halving, independently of all
others, with no stack. A prefix that touches a segment's edge may go on beyond it. Only such prefixes (those of a segment's
first and last conversation) are summed up again by key, and what an edge hides from both sides is added for the pair that
meets there. So equal conversations and common beginnings spread over any number of tasks.

Null roles and texts are empty. Turns go by number, nulls first, equal numbers by their key, so repeated rows are turns of
their own. Rows with a null conv_id are left out. Other columns are ignored. An empty table gives no node, not even a root.
One conversation is one row here, 24 bytes a turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import stored

SEGMENT = 1 << 16
TURNS = 1 << 20  # a segment also ends after so many turns
KEY = 16
CRC_SHARE = 20


def _crc32(column):
    return F.crc32(column.cast("string").cast("binary"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (binary, 16 bytes a turn, in order) and words (of each turn)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), key.alias("key"), words.alias("words")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


def rebuilt(own: DataFrame, *, share: int = CRC_SHARE) -> DataFrame:
    """Conversations with the first crc32(conv_id) % 4 turns of the first one of their `share` in place of their own."""
    h = (_crc32(F.col("conv_id")) % 4).cast("int")
    heads = own.where(F.col("conv_id") % share == 0).select(F.col("conv_id").alias("head"), F.slice("keys", 1, 3).alias("head_keys"), F.slice("words", 1, 3).alias("head_words"))
    both = own.withColumns({"h": h, "head": F.col("conv_id") - F.col("conv_id") % share}).join(heads, "head", "left")
    none = {"keys": "array<binary>", "words": "array<int>"}
    join = lambda c: F.concat(F.slice(F.coalesce(f"head_{c}", F.array().cast(none[c])), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0))))
    return both.select("conv_id", join("keys").alias("keys"), join("words").alias("words"))


class SparseTable:
    """Minima of `values` over spans of 2^k places."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place up to which all values after `start` are at least `depth`."""
        at = start + 1
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            ok = at < len(level)
            ok[ok] = level[at[ok]] >= depth[ok]
            at = at + (ok.astype(np.int64) << k)
        return at - 1

    def left(self, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place from which all values up to `end`, but its own, are at least `depth`."""
        at = end.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            begin = at - (1 << k) + 1
            ok = begin >= 0
            ok[ok] = level[begin[ok]] >= depth[ok]
            at = at - (ok.astype(np.int64) << k)
        return at


def _common(a: bytes, b: bytes) -> int:
    """Turns that two packed sequences share at their beginning."""
    n = min(len(a), len(b)) // KEY
    if not n:
        return 0
    x, y = (np.frombuffer(v, dtype=np.int64, count=2 * n) for v in (a, b))
    other = np.flatnonzero(x != y)
    return int(other[0]) // 2 if len(other) else n


def _prefix_keys(packed: bytes, upto: int) -> list[bytes]:
    """A key for each beginning of 0 to `upto` turns."""
    state, out = hashlib.md5(), []
    for k in range(upto + 1):
        out.append(state.digest())
        state.update(packed[KEY * k : KEY * (k + 1)])
    return out


NODE = "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EDGE = "ends string, part long, segment long, first boolean, packed binary, words array<int>"
COLUMNS = [x.split()[0] for x in f"{NODE}, {EDGE}".split(", ")]
TYPES = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
ARROW = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in f"{NODE}, {EDGE}".split(", ")])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def _meeting(before: tuple[bytes, list], after: tuple[bytes, list]) -> list[dict]:
    """What the edge between two neighbours hid: both sides took their nodes for whole ones."""
    (a, _), (b, words) = before, after
    common = _common(a, b)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    unended = common == len(a) // KEY  # the one before was taken for the last of a childless node
    out = []
    for d, key in enumerate(_prefix_keys(b, common)):
        saved = total[common] - total[d - 1] if d else total[common]
        out.append(dict(key=key, n_children=-int(d < common), n_leaves=-int(unended), saved_tokens=int(saved)))
    return out


def _segment(ids: np.ndarray, packed: list[bytes], words: list[list], part: int, number: int):
    """Nodes of a sorted segment: whole ones, and shares of those that touch its edges (rows with a key)."""
    n = len(ids)
    size = np.array([len(p) // KEY for p in packed], dtype=np.int64)
    lcp = np.array([-1, *map(_common, packed, packed[1:])], dtype=np.int64)
    table = SparseTable(lcp)
    # Every node by its first conversation and depth.
    count = size - lcp
    p = np.repeat(np.arange(n), count)
    d = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + lcp[p] + 1
    r = table.right(p, d)
    node = np.cumsum(count) - count  # of the first node that starts at a place
    # A node one turn deeper than what its first conversation shares has a parent that began before; the rest follow theirs.
    head = d == lcp[p] + 1
    up = d > 0
    parent = np.arange(len(p)) - 1
    joint = np.flatnonzero(head & up)
    begin = table.left(p[joint], d[joint] - 1)
    parent[joint] = node[begin] + (d[joint] - 1) - (lcp[begin] + 1)
    children = np.bincount(parent[up], minlength=len(p))
    following = np.append(lcp[1:], -1)
    leaf = np.concatenate([[0], np.cumsum(following < size)])
    starts = np.cumsum(size + 1) - size - 1  # of each conversation's running word counts, which begin with 0
    flat = np.concatenate([np.concatenate([[0], np.cumsum(w, dtype=np.int64)]) for w in words])
    shared = np.concatenate([[0], np.cumsum(np.where(lcp >= 0, flat[starts + np.maximum(lcp, 0)], 0))])
    above = np.where(d > 0, flat[starts[p] + np.maximum(d - 1, 0)], 0)
    saved = shared[r + 1] - shared[p + 1] - (r - p) * above
    leaves = leaf[r + 1] - leaf[p]
    smallest = SparseTable(ids)
    width = r - p + 1
    level = np.frexp(width.astype(float))[1] - 1
    least = np.empty(len(p), dtype=np.int64)
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        least[own] = np.minimum(smallest.levels[k][p[own]], smallest.levels[k][r[own] - (1 << int(k)) + 1])
    # Those that end here stand first in the interval, by ascending id.
    same = size[p] == d
    # Equal neighbours share all their turns, so the last equal one lies before the first longer one.
    longer = np.concatenate([[0], np.cumsum(np.append(size[1:] != size[:-1], False) | (following < size))])
    ended = np.where(same, np.minimum(r, np.searchsorted(longer, longer[p], side="right") - 1), p - 1)
    edge = (p == 0) | (r == n - 1)
    keys = {}
    for place in {0, n - 1}:
        for depth, key in enumerate(_prefix_keys(packed[place], int(size[place]))):
            keys[(int(table.left(np.array([place]), np.array([depth]))[0]), depth)] = key
    names = ids.astype(str)
    nothing = hashlib.sha256(b"").hexdigest()
    out = []
    for k in range(len(p)):
        first, depth = int(p[k]), int(d[k])
        own = dict(conv_id=int(least[k]), depth=depth, n_convs=int(width[k]), n_children=int(children[k]), n_leaves=int(leaves[k]), saved_tokens=int(saved[k]))
        listed = ",".join(names[first : int(ended[k]) + 1]) if same[k] else ""
        if edge[k]:
            above_key = keys[(int(table.left(np.array([first]), np.array([depth - 1]))[0]), depth - 1)] if depth else None
            out.append(own | dict(key=keys[(first, depth)], parent=above_key, ends=listed, part=part, segment=number))
        else:
            own["ends_sha256"] = hashlib.sha256(listed.encode()).hexdigest() if listed else nothing
            q = int(parent[k])
            if edge[q]:
                own["parent"] = keys[(int(p[q]), depth - 1)]
            else:
                own["parent_conv_id"] = int(least[q])
            out.append(own)
        if len(out) >= 8192:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _nodes(segment: int, most: int):
    def run(batches):
        part, number, last = TaskContext.get().partitionId(), 0, None
        ids, packed, words, held = [], [], [], 0

        def flush():
            nonlocal number, last
            first = (packed[0], words[0])
            if last is None:
                yield _batch([dict(part=part, first=True, packed=first[0], words=first[1])])
            else:
                yield _batch(_meeting(last, first))
            yield from _segment(np.array(ids, dtype=np.int64), packed, words, part, number)
            number, last = number + 1, (packed[-1], words[-1])

        for batch in batches:
            for c, k, w in zip(batch.column("conv_id").to_pylist(), batch.column("keys").to_pylist(), batch.column("words").to_pylist()):
                ids.append(c)
                packed.append(b"".join(k))
                words.append(w)
                held += len(k)
                if len(ids) >= segment or held >= most:
                    yield from flush()
                    ids, packed, words, held = [], [], [], 0
        if ids:
            yield from flush()
        if last is not None:
            yield _batch([dict(part=part, first=False, packed=last[0], words=last[1])])

    return run


def _seams(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            rows += _meeting((r["before"], []), (r["packed"], r["words"]))
        yield _batch(rows)


def _ends(batches):
    """key, ends_sha256: lists of one key come in order, a segment's share at a time."""
    key, state, any_yet = None, None, False
    for batch in batches:
        out = []
        for own, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if own != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state, any_yet = own, hashlib.sha256(), False
            if text:
                state.update(("," if any_yet else "").encode() + text.encode())
                any_yet = True
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.binary()), pa.array([x[1] for x in out], type=pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], type=pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def trie(sequences: DataFrame, *, segment: int = SEGMENT, most: int = TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    `sequences`: conv_id (distinct), keys, words. A null parent is the root's.
    """
    order = ["keys", "conv_id"]
    ordered = sequences.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ordered.mapInArrow(_nodes(segment, most), f"{NODE}, {EDGE}"), "trie")

    # The pairs that meet between two tasks: two rows for each task, joined by their places in turn.
    rims = found.where("packed is not null")
    by_part = W.orderBy("part")
    firsts = rims.where("first").select("part", "packed", "words", F.lag("part").over(by_part).alias("prior"))
    lasts = rims.where("not first").select(F.col("part").alias("prior"), F.col("packed").alias("before"))
    seams = firsts.join(lasts, "prior").select("before", "packed", "words").mapInArrow(_seams, f"{NODE}, {EDGE}")

    shares = found.where("key is not null").unionByName(seams)
    summed = shares.groupBy("key").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    listed = found.where("key is not null and depth is not null").select("key", "part", "segment", "ends").repartition("key").sortWithinPartitions("key", "part", "segment")
    edges = stored(summed.join(listed.select("key", "ends").mapInArrow(_ends, "key binary, ends_sha256 string"), "key"), "edges")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = edges.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = found.where("key is null and depth is not null")
    rest = edges.drop("key").unionByName(whole.where("parent is not null").select(*edges.drop("key").columns))
    return whole.where("parent is null").select(*columns).unionByName(rest.join(above, "parent", "left").select(*columns))
