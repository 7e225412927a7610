"""Sparse term vectors and sparse top-k matching."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import constants as K
from tessera.functions import terms as T
from tessera.operators.topk import SCORE_DIGITS, SHARED_ABOVE, Best, Scopes, counted_terms, for_all, item_ids, shared, top_k
from tessera.session import written

QUESTION_ROWS = 1_000_000  # most question terms shipped to every task (about 24 bytes each)
SCORE_CELLS = 4_000_000  # largest score block held by a task
OWN_TERM = 8  # a term that at most so many questions ask is looked up for each of them

# Tasks receive these helpers with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _terms): all terms of a key in one list; only the texts move, once."""
    held = texts.select(key, F.col(text).alias("_text")).groupBy(key).agg(F.collect_list("_text").alias("_texts"))
    return held.select(key, F.flatten(F.transform("_texts", T.terms)).alias("_terms"))


def term_vectors(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, hits): the hashed terms of each text with their counts, ascending by index.

    Counting takes an Arrow batch at a time, so a term is hashed once a batch and term rows are neither moved nor held.
    Terms that share an index add up, and so do texts that share a key.
    """
    source, space = whole_texts(texts, key, text), K.SPARSE_SPACE
    schema = StructType([source.schema[key], *StructType.fromDDL("hits array<struct<term_idx:int,tf:bigint>>")])

    def count(batches):
        for batch in batches:
            row, term = counted_terms(batch.column("_terms"), lambda t: int(hashlib.md5(t).hexdigest(), 16) % space)
            cells, tf = np.unique(row * space + term, return_counts=True)
            start = np.searchsorted(cells, np.arange(batch.num_rows + 1) * space).astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array((cells % space).astype(np.int32)), pa.array(tf.astype(np.int64))], ["term_idx", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(start), hits)], [key, "hits"])

    return source.mapInArrow(count, schema)


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term_idx, tf, w): one row per hashed term of each text."""
    rows = term_vectors(texts, key, text).select(key, F.inline("hits"))
    return rows.withColumn("w", T.saturate(F.col("tf")))


class _TermIndex:
    """Question weights by term: for the term at position v, entries start[v]:start[v + 1]."""

    def __init__(self, rows: pd.DataFrame, questions: pd.DataFrame, exact: list[str], optional: list[str]):
        self.ids = questions["qid"].to_numpy()
        self.scopes = Scopes(questions, exact, optional)
        self.vocabulary, place = np.unique(rows["term_idx"].to_numpy(), return_inverse=True)
        order = np.argsort(place, kind="stable")
        position = {q: i for i, q in enumerate(self.ids)}
        self.question = rows["qid"].map(position).to_numpy()[order]
        self.weight = rows["w"].to_numpy()[order]
        self.start = np.searchsorted(place[order], np.arange(len(self.vocabulary) + 1))

    def scores(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        """(questions, rows): sums of weight products; every posting meets the questions with its term."""
        begin, count = self.start[term], self.start[term + 1] - self.start[term]
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(begin, count) + steps
        cell = self.question[entry] * rows + np.repeat(row, count)
        total = np.bincount(cell, weights=self.weight[entry] * np.repeat(w, count), minlength=len(self.ids) * rows)
        return np.round(total.reshape(len(self.ids), rows), SCORE_DIGITS)


def _scan(batches, index: _TermIndex, k: int, key: str):
    best, key_type = Best(len(index.ids), k), None
    block = max(1, SCORE_CELLS // max(1, len(index.ids)))
    for whole in batches:
        for at in range(0, whole.num_rows, block):
            batch = whole.slice(at, block)
            key_type = batch.column(key).type
            hits = batch.column("hits")
            fields = hits.flatten()
            sizes = hits.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            term, w = (f.to_numpy(zero_copy_only=False) for f in fields.flatten())
            if fields.type[1].name == "tf":  # whole term vectors: most terms are nobody's
                place = np.minimum(np.searchsorted(index.vocabulary, term), max(0, len(index.vocabulary) - 1))
                asked = index.vocabulary[place] == term if len(index.vocabulary) else np.zeros(len(term), dtype=bool)
                row, term, w = row[asked], place[asked], w[asked] / (w[asked] + 0.5)
            scores = index.scores(row, term, w, batch.num_rows)
            # Without a shared term there is no hit.
            scores[scores <= 0.0] = -np.inf
            ids = item_ids(batch, key)
            for members, mask in index.scopes.masks(batch):
                best.add(members, ids[mask], scores[np.ix_(members, mask)])
    yield from best.rows(index.ids, key, key_type)


def _grouped(chunk_postings: DataFrame, index: _TermIndex, key: str) -> DataFrame:
    """(key, hits): the postings of asked terms by key, terms by their place in the vocabulary."""
    spark = chunk_postings.sparkSession
    terms = pd.DataFrame({"term_idx": index.vocabulary.astype("int32"), "v": np.arange(len(index.vocabulary), dtype="int32")})
    wanted = spark.createDataFrame(terms, "term_idx int, v int")
    # The vocabulary is bounded by max_question_rows, so it is safe to broadcast.
    found = chunk_postings.select(key, "term_idx", "w").join(F.broadcast(wanted), "term_idx")
    return found.groupBy(key).agg(F.collect_list(F.struct("v", "w")).alias("hits"))


def sparse_top_k(
    chunk_postings: DataFrame,
    question_postings: DataFrame,
    k: int = K.DEFAULT_TOP_K,
    key: str = "chunk_id",
    chunk_scope: DataFrame | None = None,
    question_scope: DataFrame | None = None,
    exact: list[str] | None = None,
    optional: list[str] | None = None,
    max_question_rows: int = QUESTION_ROWS,
    shared_above: int = SHARED_ABOVE,
) -> DataFrame:
    """(qid, key, score, sparse_rank): sum of weight products over shared terms.

    `chunk_postings` are rows of `postings` or, better, of `term_vectors`, which need no grouping.

    `chunk_scope` (key, filter columns) and `question_scope` (qid, filter columns) restrict what a
    question may see; the restriction applies before ranking.

    Question postings up to `max_question_rows` go to every task, which keeps k hits per question, so
    (question, chunk) scores never become rows; postings of terms nobody asked for are dropped first.
    More questions than that go through a block-max index, see `sparse_blocks`.

    In a batch of more than `shared_above` questions, what they have in common is searched once, see `_shared_top_k`.
    """
    exact, optional = exact or [], optional or []
    scope = exact + optional
    asked = question_postings.select(F.col("qid").cast("long").alias("qid"), "term_idx", "w")
    if shared_above < sys.maxsize and asked.select("qid").distinct().limit(shared_above + 1).count() > shared_above:
        return _shared_top_k(chunk_postings, asked, k, key, chunk_scope, question_scope, exact, optional, max_question_rows)
    small = asked.limit(max_question_rows + 1).toPandas()
    if len(small) > max_question_rows:
        from tessera.operators.sparse_blocks import block_index, block_top_k

        if "hits" in chunk_postings.columns:
            chunk_postings = chunk_postings.select(key, F.inline("hits")).withColumn("w", T.saturate(F.col("tf")))
        index = block_index(chunk_postings, key, chunk_scope, exact)
        return block_top_k(index, asked, k, key, chunk_scope, question_scope, exact, optional, max_question_rows=max_question_rows).hits
    heads = small[["qid"]].drop_duplicates()
    if scope:
        # Only questions with terms matter, and those are within the limit just checked.
        known = chunk_postings.sparkSession.createDataFrame(heads, "qid long")
        heads = question_scope.select(F.col("qid").cast("long").alias("qid"), *scope).join(F.broadcast(known), "qid").toPandas()
    index = _TermIndex(small, heads.reset_index(drop=True), exact, optional)
    if "hits" in chunk_postings.columns:
        packed = chunk_postings.select(key, "hits")
    else:
        packed = _grouped(chunk_postings, index, key)
    if scope:
        packed = packed.join(chunk_scope.select(key, *scope), key)
    schema = StructType([*StructType.fromDDL("qid long"), chunk_postings.schema[key], *StructType.fromDDL("score double")])

    def scan(batches):
        yield from _scan(batches, index, k, key)

    kept = packed.mapInArrow(scan, schema).where(F.col("score") > 0)
    return top_k(kept, k, "qid", key, "score", "sparse_rank")


def _shared_top_k(chunk_postings: DataFrame, asked: DataFrame, k: int, key: str, chunk_scope: DataFrame | None, question_scope: DataFrame | None,
                  exact: list[str], optional: list[str], max_question_rows: int) -> DataFrame:
    """`sparse_top_k` of many questions that are partly alike.

    A question's own terms are those that few questions ask; the others are its base. Questions of equal bases and filters share
    one search for the k best chunks by their base alone. A chunk without any of a question's own terms has its base score and
    is a hit only as one of these k, for those before it never score less than by their base. The chunks that hold own terms are
    found through these, at most OWN_TERM times each posting, and get their whole scores.
    """
    scope = exact + optional
    if "hits" in chunk_postings.columns:
        chunk_postings = chunk_postings.select(key, F.inline("hits")).withColumn("w", T.saturate(F.col("tf")))
    if scope:
        question_scope = question_scope.select(F.col("qid").cast("long").alias("qid"), *scope)
        asked = asked.join(question_scope.select("qid"), "qid", "left_semi")
    asked = written(asked, "asked")
    terms = asked.groupBy("term_idx").agg((F.count("*") <= OWN_TERM).alias("_own"))
    lists = chunk_postings.select(key, "term_idx", "w").join(asked.select("term_idx").distinct(), "term_idx", "left_semi")
    if scope:
        lists = lists.join(chunk_scope.select(key), key, "left_semi")
    lists = written(lists, "lists")
    # Terms that no chunk holds tell no questions apart.
    known = written(asked.join(terms, "term_idx").join(lists.select("term_idx").distinct(), "term_idx", "left_semi"), "known")
    own = known.where("_own")

    bases = known.where("not _own").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term_idx", "w"))).alias("_base"))
    if scope:
        bases = bases.join(question_scope, "qid")
    alike = shared(bases, F.to_json(F.struct(*scope, "_base")))
    heads = alike.where("qid = _head")
    limits = dict(chunk_scope=chunk_scope, question_scope=heads.select("qid", *scope), exact=exact, optional=optional) if scope else {}
    best = sparse_top_k(lists, heads.select("qid", F.inline("_base")), k, key, max_question_rows=max_question_rows, shared_above=sys.maxsize, **limits)
    by_base = for_all(best.select("qid", key, "score"), alike)

    held = own.select("qid", "term_idx").join(lists.select("term_idx", key), "term_idx").select("qid", key).distinct()
    if scope:
        sides = [F.col(c) == F.col(f"_q_{c}") for c in exact] + [F.col(f"_q_{c}").isNull() | (F.col(c) == F.col(f"_q_{c}")) for c in optional]
        held = held.join(question_scope.select("qid", *[F.col(c).alias(f"_q_{c}") for c in scope]), "qid").join(chunk_scope.select(key, *scope), key)
        for side in sides:
            held = held.where(side)
        held = held.select("qid", key)
    rows = held.join(known.select("qid", "term_idx", F.col("w").alias("_qw")), "qid").join(lists, [key, "term_idx"])
    whole = rows.groupBy("qid", key).agg(F.round(F.sum(F.col("_qw") * F.col("w")), SCORE_DIGITS).alias("score")).where("score > 0")
    both = by_base.unionByName(whole).groupBy("qid", key).agg(F.max("score").alias("score"))
    return top_k(both, k, "qid", key, "score", "sparse_rank")
