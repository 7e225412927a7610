"""Sparse top-k over a block-max index: postings in blocks with their greatest weight, of which a search opens few.

A block holds postings of one scope (the exact filter columns), term and weight level; terms with many postings of a level are
cut by a hash of the key, so no block and no group grows with the data. A search of any number of questions runs in three
joins:

1. The rarest terms of each question, up to `seed_rows` postings, give first candidates; the k-th best of their whole scores
   is a bound that every hit has to reach.
2. Terms are taken from the most common one on while the sum of their greatest possible gains stays below the bound: no key
   that has only such terms can be a hit. Of the other terms' blocks, those are opened whose greatest weight, with all that
   the other terms could add, reaches the bound.
3. Keys whose partial score, with all that the common terms could add, still reaches the bound look these terms up by key.
   Where the questions fit into a task, the postings of each key in an opened block meet there instead, and all questions are
   scored over Arrow batches, so (question, key) pairs never become rows.

Scores, ties and ranks are those of a join of all postings, whatever the bound.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import constants as K
from tessera.operators.sparse import QUESTION_ROWS, SCORE_CELLS, _TermIndex
from tessera.operators.topk import SCORE_DIGITS, Best, item_ids, top_k
from tessera.session import written

BLOCK = 512
SEED_ROWS = 4096
SLACK = 1e-8  # rounding of sums

# Tasks receive these helpers with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def block_index(postings: DataFrame, key: str = "chunk_id", scope: DataFrame | None = None, exact: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(*exact, term_idx, level, part, top, n, hits): `postings` (key, term_idx, w) with the exact columns of `scope` (key, ...).

    Write it partitioned by the exact columns and sorted by term to search it often.
    """
    exact = exact or []
    rows = postings.select(key, "term_idx", "w")
    if exact:
        rows = rows.join(scope.select(key, *exact), key)
    group = [*exact, "term_idx", "level"]
    rows = rows.withColumn("level", F.floor(F.col("w") * 16).cast("int"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > block).withColumn("parts", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    dealt = rows.join(large, group, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(key), F.col("parts")).cast("int"), F.lit(0)))
    return dealt.groupBy(*group, "part").agg(F.max("w").alias("top"), F.count("*").alias("n"), F.collect_list(F.struct(F.col(key).alias("key"), "w")).alias("hits"))


class Found(NamedTuple):
    """Ranked hits, and the rows that were scored to find them."""

    hits: DataFrame
    candidates: DataFrame


def block_top_k(index: DataFrame, question_postings: DataFrame, k: int = K.DEFAULT_TOP_K, key: str = "chunk_id", chunk_scope: DataFrame | None = None,
                question_scope: DataFrame | None = None, exact: list[str] | None = None, optional: list[str] | None = None, seed_rows: int = SEED_ROWS,
                max_question_rows: int = QUESTION_ROWS) -> Found:
    """(qid, key, score, sparse_rank), as `sparse.sparse_top_k` gives them, and the candidates (qid, key) whose scores were summed up.

    Up to `max_question_rows` question terms go to every task, where step 3 takes all postings of a key at once; more meet the
    blocks by joins.
    """
    exact, optional = exact or [], optional or []
    asked = question_postings.select(F.col("qid").cast("long").alias("qid"), "term_idx", F.col("w").alias("qw"))
    if exact or optional:
        asked = asked.join(question_scope.select(F.col("qid").cast("long").alias("qid"), *exact, *[F.col(c).alias(f"_q_{c}") for c in optional]), "qid")
    term = [*exact, "term_idx"]
    wanted = written(index.join(asked.select(*term).distinct(), term, "left_semi"), "blocks")
    stats = wanted.groupBy(*term).agg(F.max("top").alias("most"), F.sum("n").alias("df"))
    gain = F.col("qw") * F.col("most")
    by_df = W.partitionBy("qid").orderBy("df", "term_idx")
    # Windows here hold the terms of one question.
    terms = asked.join(stats, term).withColumns({"gain": gain, "place": F.row_number().over(by_df), "rows": F.sum("df").over(by_df)})
    terms = written(terms.withColumn("all_gain", F.sum("gain").over(W.partitionBy("qid"))), "terms")

    def scored(pairs: DataFrame) -> DataFrame:
        """Sums over the postings of (qid, term) pairs, within the optional filters."""
        rows = pairs.withColumn("_h", F.explode("hits")).select("qid", F.col("_h.key").alias(key), (F.col("qw") * F.col("_h.w")).alias("_p"), *[f"_q_{c}" for c in optional])
        sums = rows.groupBy("qid", key, *[f"_q_{c}" for c in optional]).agg(F.sum("_p").alias("part"))
        if optional:
            sums = sums.join(chunk_scope.select(key, *optional), key)
            for c in optional:
                sums = sums.where(F.col(f"_q_{c}").isNull() | (F.col(c) == F.col(f"_q_{c}")))
        return sums.select("qid", key, "part")

    def looked_up(keys: DataFrame, which: DataFrame) -> DataFrame:
        """(qid, key, more): what the terms of `which` (qid, term) add to given keys; each posting list is opened once."""
        need = keys.select("qid", key).join(which.select("qid", *term, "qw"), "qid")
        lists = wanted.join(which.select(*term).distinct(), term, "left_semi").select(*term, F.explode("hits").alias("_h")).select(*term, F.col("_h.key").alias(key), "_h.w")
        lists = lists.join(keys.select(key).distinct(), key, "left_semi")
        return need.join(lists, [*term, key]).groupBy("qid", key).agg(F.sum(F.col("qw") * F.col("w")).alias("more"))

    seeds = terms.where((F.col("rows") <= seed_rows) | (F.col("place") == 1))
    first = top_k(scored(seeds.join(wanted, term)), k, "qid", key, "part").select("qid", key)
    whole = looked_up(first, terms).groupBy("qid").agg(F.count("*").alias("_n"), F.min("more").alias("_k"))
    bound = whole.select("qid", F.when(F.col("_n") >= k, F.col("_k") - SLACK).otherwise(0.0).alias("bound"))

    common = W.partitionBy("qid").orderBy(F.col("df").desc(), F.col("term_idx").desc())
    split = terms.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))).withColumn("below", F.sum("gain").over(common))
    split = written(split.withColumn("needed", F.col("below") >= F.col("bound")), "split")
    shipped = split.limit(max_question_rows + 1).toPandas()
    if len(shipped) <= max_question_rows:
        return _scanned(wanted, split, shipped, k, key, chunk_scope, exact, optional)

    opened = split.where("needed").join(wanted, term).where(F.col("qw") * F.col("top") + F.col("all_gain") - F.col("gain") >= F.col("bound"))
    rest = split.groupBy("qid").agg(F.first("bound").alias("bound"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("gain"))), F.lit(0.0)).alias("rest"))
    # Skipped blocks of needed terms may hold postings of a candidate, one for each term.
    skipped = split.where("needed").join(wanted, term).where(F.col("qw") * F.col("top") + F.col("all_gain") - F.col("gain") < F.col("bound"))
    reach = skipped.groupBy("qid", *term).agg(F.max(F.col("qw") * F.col("top")).alias("_s")).groupBy("qid").agg(F.sum("_s").alias("_s"))
    near = scored(opened).join(rest, "qid").join(reach, "qid", "left")
    near = near.where(F.col("part") + F.col("rest") + F.coalesce("_s", F.lit(0.0)) >= F.col("bound"))
    candidates = written(near.select("qid", key), "candidates")
    total = looked_up(candidates, terms).withColumn("score", F.round("more", SCORE_DIGITS)).where("score > 0")
    return Found(top_k(total.select("qid", key, "score"), k, "qid", key, "score", "sparse_rank"), candidates)


class _Bounds:
    """Per question of an index: the score that a hit has to reach, and what the common terms could add."""

    def __init__(self, rows: pd.DataFrame, ids: np.ndarray):
        by_question = rows.groupby("qid")
        self.bound = by_question["bound"].first().reindex(ids).to_numpy()
        self.rest = rows["gain"].where(~rows["needed"], 0.0).groupby(rows["qid"]).sum().reindex(ids).to_numpy()


def _score_batches(batches, index: _TermIndex, needed: _TermIndex, bounds: _Bounds, k: int, key: str, pairs: bool):
    """The k best keys of each question, or with `pairs` the (qid, key) whose needed terms let them reach the bound."""
    best, key_type = Best(len(index.ids), k), None
    best.floor = bounds.bound.copy()
    block = max(1, SCORE_CELLS // max(1, len(index.ids)))
    for whole in batches:
        for at in range(0, whole.num_rows, block):
            batch = whole.slice(at, block)
            key_type, hits = batch.column(key).type, batch.column("hits")
            row = np.repeat(np.arange(batch.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
            term, w = (f.to_numpy(zero_copy_only=False) for f in hits.flatten().flatten())
            ids = item_ids(batch, key)
            scores = (needed if pairs else index).scores(row, np.searchsorted(index.vocabulary, term), w, batch.num_rows)
            for members, mask in index.scopes.masks(batch):
                seen = scores[np.ix_(members, mask)]
                if pairs:
                    q, c = np.nonzero((seen > 0.0) & (seen + (bounds.rest - bounds.bound)[members, None] >= -SLACK))
                    yield pa.RecordBatch.from_arrays([pa.array(index.ids[members[q]]), pa.array(ids[mask][c].tolist(), key_type)], ["qid", key])
                else:
                    # Without a shared term there is no hit.
                    seen[seen <= 0.0] = -np.inf
                    best.add(members, ids[mask], seen)
    if not pairs:
        yield from best.rows(index.ids, key, key_type)


def _scanned(wanted: DataFrame, split: DataFrame, shipped: pd.DataFrame, k: int, key: str, chunk_scope: DataFrame | None,
             exact: list[str], optional: list[str]) -> Found:
    """Step 3 of `block_top_k` inside tasks: `shipped` are the rows of `split`."""
    term = [*exact, "term_idx"]
    # A hit stands in a block that its question opens: whose top is at least this.
    reach = ((F.col("bound") - F.col("all_gain") + F.col("gain")) / F.col("qw")).alias("_r")
    least = split.where("needed").select(*term, reach).groupBy(*term).agg((F.min("_r") - SLACK).alias("_least"))
    blocks = wanted.join(least, term, "left").withColumn("_open", F.coalesce(F.col("top") >= F.col("_least"), F.lit(False)))
    rows = blocks.select(*term, "_open", F.explode("hits").alias("_h")).select(*term, "_open", F.col("_h.key").alias(key), "_h.w")
    packed = rows.groupBy(key, *exact).agg(F.collect_list(F.struct("term_idx", "w")).alias("hits"), F.max("_open").alias("_open")).where("_open").drop("_open")
    if optional:
        packed = packed.join(chunk_scope.select(key, *optional), key)
    heads = shipped.drop_duplicates("qid").rename(columns={f"_q_{c}": c for c in optional})[["qid", *exact, *optional]].reset_index(drop=True)
    terms = shipped[["qid", "term_idx", "qw"]].rename(columns={"qw": "w"})
    index = _TermIndex(terms, heads, exact, optional)
    # The same places, with nothing to gain from a term that its question does not need.
    needed = _TermIndex(terms.assign(w=terms["w"].where(shipped["needed"], 0.0)), heads, exact, optional)
    bounds = _Bounds(shipped, index.ids)
    pair = StructType([*StructType.fromDDL("qid long"), packed.schema[key]])
    scored = StructType([*pair, *StructType.fromDDL("score double")])

    def hits(batches):
        yield from _score_batches(batches, index, needed, bounds, k, key, False)

    def candidates(batches):
        yield from _score_batches(batches, index, needed, bounds, k, key, True)

    kept = packed.mapInArrow(hits, scored).where("score > 0")
    return Found(top_k(kept, k, "qid", key, "score", "sparse_rank"), packed.mapInArrow(candidates, pair))
