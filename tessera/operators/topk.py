"""Best k items per question: inside a task over Arrow batches, and across tasks."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

SCORE_DIGITS = 9
SHARED_ABOVE = 1024  # batches of more questions than this are looked through for questions that are alike

# Tasks receive these helpers with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def top_k(scored: DataFrame, k: int, group: str, item: str, score: str, out: str = "rank") -> DataFrame:
    """Best k items per group, ranked from 0; ties go to the smaller id.

    The filter is on the bare row number: Spark then prunes to k per task before the shuffle, so a hot
    group sends only k rows per task.
    """
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    ranked = scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return ranked.withColumn(out, F.col("_n") - 1).drop("_n")


def shared(questions: DataFrame, same: Column) -> DataFrame:
    """`questions` with `_head`, the least qid among those of equal `same` (a string): what holds for it holds for all of them."""
    keyed = questions.withColumn("_same", F.sha2(same, 256))
    heads = keyed.groupBy("_same").agg(F.min("qid").alias("_head"))
    return written(keyed.join(heads, "_same").drop("_same"), "shared")


def for_all(hits: DataFrame, alike: DataFrame) -> DataFrame:
    """`hits` of the heads, given to every question of `alike` (qid, _head)."""
    return alike.select("qid", "_head").join(hits.withColumnRenamed("qid", "_head"), "_head").drop("_head")


def counted_terms(lists: pa.Array, codes_of) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each term in a batch of term lists; `codes_of` maps distinct terms, as bytes, to numbers."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    held = lists.flatten().cast(pa.binary()).dictionary_encode()
    codes = np.fromiter((codes_of(t) for t in held.dictionary.to_pylist()), dtype=np.int64, count=len(held.dictionary))
    return np.repeat(np.arange(len(lists)), sizes), codes[held.indices.to_numpy(zero_copy_only=False)]


class Scopes:
    """Questions grouped by equal filter values, so each group is masked once per batch."""

    def __init__(self, rows: pd.DataFrame, exact: list[str], optional: list[str]):
        self.exact, self.names = exact, exact + optional
        groups: dict[tuple, list[int]] = {}
        values = zip(*[rows[c] for c in self.names]) if self.names else [()] * len(rows)
        for i, scope in enumerate(values):
            groups.setdefault(tuple(None if v is None or v != v else v for v in scope), []).append(i)
        self.groups = [(scope, np.array(members)) for scope, members in groups.items()]

    def masks(self, batch: pa.RecordBatch):
        """(question positions, allowed rows) per group with anything to see in the batch."""
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in self.names}
        for scope, members in self.groups:
            mask = np.ones(batch.num_rows, dtype=bool)
            for name, value in zip(self.names, scope):
                if value is not None:
                    mask &= columns[name] == value
                elif name in self.exact:
                    mask[:] = False
            if mask.any():
                yield members, mask


class Best:
    """Running k best per question over the batches of one task; infinity stands for NaN, which ranks first as in SQL."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.floor = np.full(questions, -np.inf)
        self.q = np.empty(0, dtype=np.int64)
        self.ids = self.scores = None

    def add(self, members: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """`scores` is (members, ids).  Only entries at or above a question's k-th best so far can matter."""
        bar = self.floor[members]
        if scores.shape[1] > self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            bar = np.maximum(bar, kth)
        at, column = np.nonzero(scores >= bar[:, None])
        q, found, value = members[at], ids[column], scores[at, column]
        if self.ids is not None:
            q = np.concatenate([self.q, q])
            found = np.concatenate([self.ids, found])
            value = np.concatenate([self.scores, value])
        order = np.lexsort((found, -value, q))
        q, found, value = q[order], found[order], value[order]
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        keep = place < self.k
        self.q, self.ids, self.scores = q[keep], found[keep], value[keep]
        full = (place == self.k - 1)
        self.floor[q[full]] = value[full]

    def rows(self, question_ids: np.ndarray, key: str, key_type: pa.DataType):
        if self.ids is not None and len(self.ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array(question_ids[self.q]), pa.array(self.ids.tolist(), key_type), pa.array(np.where(self.scores == np.inf, np.nan, self.scores))],
                ["qid", key, "score"],
            )


def item_ids(batch: pa.RecordBatch, key: str) -> np.ndarray:
    ids = batch.column(key).to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids
