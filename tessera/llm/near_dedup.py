"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of five words. Its sketch: leading bits of a shingle's hash choose a register, which
keeps the smallest remainder as a leading-zero count and some mantissa bits. Empty registers of small sets copy a full one,
chosen by a fixed random order. Bands of three registers are the keys under which documents meet; at a similarity of 0.75 a
pair misses all of them with probability 1e-10.

Documents with equal sets are one class; its smallest id stands for it. Under each key the first class meets every other
(a star, not all pairs). Pairs whose estimated similarity, corrected for register collisions, is too low by six standard
errors are dropped; the rest is verified on full sets. Classes that met under any key, directly or through others, are a
family. Where a family still has several components, all its members outside the largest one are compared with the whole
family by exact intersections, in tiles of bounded size that hand on one link per member and component. So no link is lost
to the stars, and no row is made for a pair that isn't one.

A text without words is linked with nothing; nulls count as empty. A null id is kept and has no component. Rows with equal
ids are one node: it has the links of all its texts. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.bytescan import mix, shingles, slices, words
from tessera.llm.components import components
from tessera.llm.shared import stored

WIDTH = 5
PERCENT = 75
BITS = 7
REGISTERS = 1 << BITS
MANTISSA = 10
ROWS = 3
BANDS = REGISTERS // ROWS
ERRORS = 6.0
TILE = 2048
_U = np.uint64

_ORDER = np.stack([np.random.default_rng(REGISTERS + k).permutation(REGISTERS) for k in range(REGISTERS)])


def compressed(least: np.ndarray) -> np.ndarray:
    """Registers of smallest remainders: leading zeros, then the bits after the first one."""
    x = least.copy()
    zeros = np.zeros(x.shape, dtype=np.uint16)
    for step in (32, 16, 8, 4, 2, 1):
        small = x < (_U(1) << _U(64 - step))
        zeros[small] += np.uint16(step)
        x = np.where(small, x << _U(step), x)
    zeros = np.minimum(zeros, np.uint16(62))
    return (zeros << np.uint16(MANTISSA)) | ((x >> _U(63 - MANTISSA)) & _U((1 << MANTISSA) - 1)).astype(np.uint16)


def filled(registers: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first full one in an order of their own."""
    out = registers.copy()
    for row in np.flatnonzero(~full.all(axis=1) & full.any(axis=1)):
        empty = np.flatnonzero(~full[row])
        order = _ORDER[empty]
        out[row, empty] = registers[row, order[np.arange(len(empty)), full[row][order].argmax(axis=1)]]
    return out


def shingle_sets(column: pa.Array, width: int = WIDTH):
    """(row, sorted distinct shingle hashes) of every text."""
    for row, _, data, offsets in slices(column):
        hashes, first = words(data, offsets)
        for k in range(len(offsets) - 1):
            yield row + k, np.unique(shingles(hashes[first[k] : first[k + 1]], width))


SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, registers binary"


def _sketches(width: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            least, full = np.full((n, REGISTERS), _U(0)), np.zeros((n, REGISTERS), dtype=bool)
            sizes, sums = np.zeros(n, dtype=np.int64), np.zeros((n, 2), dtype=_U)
            for row, own in shingle_sets(batch.column("text"), width):
                sizes[row] = len(own)
                if len(own):
                    at = (own >> _U(64 - BITS)).astype(np.int64)
                    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    least[row, at[heads]], full[row, at[heads]] = own[heads] << _U(BITS), True
                    sums[row] = mix(own).sum(), mix(own ^ _U(0x9E3779B97F4A7C15)).sum()
            registers = filled(compressed(least), full)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), *(pa.array(np.ascontiguousarray(sums[:, j]).view(np.int64)) for j in (0, 1)), pa.array([r.tobytes() if s else None for r, s in zip(registers, sizes)], type=pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "registers"],
            )

    return run


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, a 128-bit sum of the set, registers (null for an empty set)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketches(width), SKETCH)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        m = _matrix(batch.column("registers")).astype(_U)
        keys = [mix(((m[:, ROWS * b] << _U(32)) | (m[:, ROWS * b + 1] << _U(16)) | m[:, ROWS * b + 2]) + (_U(b + 1) << _U(48))) for b in range(BANDS)]
        reps = batch.column("rep").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(reps, BANDS))], names=["key", "rep"])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, less those expected to be equal by chance.

    For sets of n and m different elements a register collides with about this probability (Yu and Weber's approximation).
    """
    same = (a == b).mean(axis=1)
    ratio = np.minimum(n, m) / np.maximum(n, m)
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 * 2.0 ** (1 - MANTISSA)
    return (same - chance) / (1 - chance)


def _floor(percent: int) -> float:
    share = percent / 100
    return share - ERRORS * (share * (1 - share) / REGISTERS) ** 0.5


def _plausible(percent: int):
    """Pairs that may reach the similarity: by their sizes for certain, by the estimate but for six standard errors."""
    floor = _floor(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            likely = estimate(_matrix(batch.column("ra")), _matrix(batch.column("rb")), n, m) >= floor
            likely |= np.maximum(n, m) < REGISTERS  # small sets: the copies of registers make the error larger
            stays = pa.array(likely & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(stays) for c in ("a", "b")], names=["a", "b"])

    return run


def _linked(percent: int, width: int):
    def run(batches):
        for batch in batches:
            sides = [shingle_sets(batch.column(c), width) for c in ("ta", "tb")]
            hit = []
            for (_, x), (_, y) in zip(*sides):
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            stays = pa.array(hit, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(stays) for c in ("a", "b")], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_linked(percent, width), "a long, b long").distinct()


def _across(percent: int):
    """One link for each asker and component of targets that is similar enough, by exact intersections within a tile."""

    def pairs(rows):
        sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
        if not all(sides):
            return
        targets, askers = sides
        sizes = np.array([len(r[3]) // 8 for r in targets])
        comps = np.array([r[2] for r in targets], dtype=np.int64)
        flat = np.frombuffer(b"".join(r[3] for r in targets), dtype=_U)
        owner = np.repeat(np.arange(len(targets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for _, rep, comp, packed in askers:
            own = np.frombuffer(packed, dtype=_U)
            low, high = np.searchsorted(flat, own, side="left"), np.searchsorted(flat, own, side="right")
            count = high - low
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            both = np.bincount(owner[at], minlength=len(targets))
            hit = np.flatnonzero((both > 0) & (100 * both >= percent * (len(own) + sizes - both)) & (comps != comp))
            for k in hit[np.unique(comps[hit], return_index=True)[1]].tolist():
                yield min(rep, targets[k][1]), max(rep, targets[k][1])

    def run(batches):
        now, rows = None, []

        def done():
            found = sorted(set(pairs(rows)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], type=pa.int64()) for j in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "slot", "block", "side", "rep", "component", "shingles")]
            for family, slot, block, *row in zip(*columns):
                if (family, slot, block) != now:
                    yield from done()
                    now, rows = (family, slot, block), []
                rows.append(row)
        yield from done()

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            packed = [own.tobytes() for _, own in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, type=pa.binary())], names=["rep", "shingles"])

    return run


def _tiles(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of mixed families under the tiles where they meet: all of a family as targets, dealt into slots, and those
    outside its largest component as askers, dealt into blocks. A tile holds one slot and one block.

    `members`: rep, family, component. `sizes`: family, size, main, apart (members outside the main component).
    """
    rows = members.join(sizes, "family").withColumns({"slots": F.ceil(F.col("size") / TILE).cast("int"), "blocks": F.ceil(F.col("apart") / TILE).cast("int")})
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    targets = rows.select("family", "rep", "component", F.lit(0).alias("side"), deal("slots").alias("slot"), each("blocks").alias("block"))
    askers = rows.where("component <> main").select("family", "rep", "component", F.lit(1).alias("side"), each("slots").alias("slot"), deal("blocks").alias("block"))
    return targets.unionByName(askers)


def links(docs: DataFrame, sketched: DataFrame, *, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Links (a, b) between classes, enough to give every component; and between the classes of a repeated id.

    `sketched`: `sketches(docs)`, stored.
    """
    some = sketched.where("doc_id is not null and n_shingles > 0")
    classes = stored(some.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("registers").alias("registers")), "classes")
    keyed = classes.select("rep", "registers").mapInArrow(_bands, "key long, rep long")
    first = F.first("rep").over(W.partitionBy("key").orderBy("rep"))
    stars = stored(keyed.select(first.alias("a"), F.col("rep").alias("b")).where("a < b").distinct(), "stars")
    sketch = lambda c: classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    likely = stars.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_plausible(percent), "a long, b long")
    # The whole texts move once; what follows reads those that met others.
    met = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct()
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = stored(whole.join(met.hint("merge"), "doc_id", "left_semi"), "met")
    found = _verified(likely, texts, percent, width)
    least = F.min("rep").over(W.partitionBy("doc_id"))
    same_id = some.join(classes.select("n_shingles", "h1", "h2", "rep"), ["n_shingles", "h1", "h2"]).select("doc_id", "rep").distinct()
    same_id = same_id.select(least.alias("a"), F.col("rep").alias("b")).where("a <> b")
    found = stored(found.unionByName(same_id), "linked")

    # Whatever meets anywhere is one family. Where the stars' links leave it in several components, these meet in tiles.
    labels = components(found).withColumnRenamed("node", "rep")
    families = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    placed = stored(families.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "families")
    counts = placed.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("family").agg(F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n"))
    sizes = sizes.select("family", "size", "main", (F.col("size") - F.col("n")).alias("apart")).where("apart > 0 and size > 2")
    members = placed.join(sizes.select("family"), "family", "left_semi")
    mixed = texts.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = stored(mixed.mapInArrow(_sets(width), "rep long, shingles binary"), "sets")
    tiles = _tiles(members, sizes).join(sets, "rep").repartition("family", "slot", "block").sortWithinPartitions("family", "slot", "block", "side")
    return found.unionByName(tiles.mapInArrow(_across(percent), "a long, b long"))


def groups(docs: DataFrame, *, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept, of every row of `docs` (doc_id, text)."""
    sketched = stored(sketches(docs, width), "sketches")
    labels = components(links(docs, sketched, percent=percent, width=width))
    some = sketched.where("doc_id is not null and n_shingles > 0")
    reps = some.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    known = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = sketched.drop("registers").join(known, ["n_shingles", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the one with the smallest id (null last), then the smallest hash of its text.

    Rows are told apart by (id, text), and grouped by their texts, so null and repeated ids are linked like any others. Of
    rows equal in both, one stays. Texts without words are linked with nothing.
    """
    th = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), th.alias("_th"))
    found = groups(docs.select(th.alias("doc_id"), F.col("text")), **options)
    found = stored(found.where("n_shingles > 0").select(F.col("doc_id").alias("_th"), F.col("component_id").alias("_c")).distinct(), "grouped")
    members = stored(rows.select("_id", "_th").distinct().join(found, "_th"), "members")
    best = members.groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_th")).alias("_best"))
    same = lambda a, b: F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._th") == F.col(f"{b}._th"))
    gone = members.alias("m").join(best.select("_best.*").alias("b"), same("m", "b"), "left_anti")
    left = rows.alias("r").join(gone.alias("g"), same("r", "g"), "left_anti")
    # Rows equal in id and text meet where the join has put them; nothing tells them apart, so their order is any.
    first = F.row_number().over(W.partitionBy("_id", "_th").orderBy("_id"))
    return left.withColumn("_n", first).where("_n = 1").select("_row.*")
