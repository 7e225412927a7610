"""Exact cosine top-k over clustered vectors: clusters that cannot hold a hit are not opened.

Vectors are dealt to the nearest of some centres, and each cluster knows its radius, the largest angle between its centre and
a member.  By the triangle inequality of angles no member is nearer to a question than its angle to the centre less the
radius.  The nearest clusters of a question with k members give a first list; its k-th score is a bound, and of all other
clusters only those that may reach it meet the question.  A cluster is cut into parts of bounded size by a hash of the key,
so a crowded one is many groups.

Centres are a bounded sample (`centres` vectors at most, of unit length); they go to every task, 8 bytes a number.  Which
vectors they are changes how much is skipped, never the result.  Vectors of length zero have the score 0 with everything.
Vectors with NaN cells lie nowhere: they make a cluster that every question opens, and a question of that kind opens all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import constants as K
from tessera.operators.dense import _Questions, _score_batches, _unit_rows
from tessera.operators.topk import top_k
from tessera.session import written

CENTRES = 1024
PART_ROWS = 8192
SLACK = 1e-7  # of an angle, for rounding

# Tasks receive these helpers with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Clusters(NamedTuple):
    """vectors: key, dense, the other columns, cluster, part; shapes: cluster, n, radius, parts; the centres themselves."""

    vectors: DataFrame
    shapes: DataFrame
    centres: np.ndarray


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit_rows(vectors) @ centres.T, -1.0, 1.0))


def cluster_index(chunks: DataFrame, key: str = "chunk_id", centres: int = CENTRES, part_rows: int = PART_ROWS) -> Clusters:
    """The vectors of `chunks` (key, dense, any other columns) by cluster."""
    drawn = chunks.where(F.exists("dense", lambda x: x != 0) & ~F.exists("dense", F.isnan)).select("dense").orderBy(F.xxhash64("dense")).limit(centres).toPandas()
    middle = _unit_rows(np.array(drawn["dense"].tolist(), dtype=np.float64).reshape(len(drawn), -1))
    schema = StructType([*chunks.schema, *StructType.fromDDL("cluster int, angle double")])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("dense").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            matrix = flat.reshape(batch.num_rows, -1)
            lost = np.isnan(matrix).any(axis=1)
            matrix = np.where(lost[:, None], 0.0, matrix)
            angles = _angles(matrix, middle) if len(middle) else np.zeros((batch.num_rows, 1))
            best = angles.argmin(axis=1)
            # A vector of length zero is at a right angle to everything, so it stays apart.
            empty = ~matrix.any(axis=1)
            own = np.where(lost, -2, np.where(empty, -1, best)).astype(np.int32)
            out = np.where(empty, 0.0, angles[np.arange(len(best)), best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(out)], names=[*batch.schema.names, "cluster", "angle"])

    placed = written(chunks.mapInArrow(assign, schema), "clustered")
    shapes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    shapes = shapes.withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
    # One row for each centre, so this goes to every task.
    dealt = placed.join(F.broadcast(shapes.select("cluster", "parts")), "cluster").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    return Clusters(dealt.drop("parts", "angle"), shapes, middle)


class Found(NamedTuple):
    """Ranked hits, and the clusters that each question opened (qid, cluster, n)."""

    hits: DataFrame
    opened: DataFrame


def cluster_top_k(index: Clusters, questions: DataFrame, k: int = K.DEFAULT_TOP_K, key: str = "chunk_id", exact: list[str] | None = None, optional: list[str] | None = None) -> Found:
    """(qid, key, score, dense_rank), as `dense.dense_top_k` gives them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    exact, optional = exact or [], optional or []
    scope = exact + optional
    asked = written(questions.select(F.col("qid").cast("long").alias("qid"), "qdense", *scope), "questions")
    shapes = index.shapes.toPandas()  # one row for each centre
    number, size, radius, parts = (shapes[c].to_numpy() for c in ("cluster", "n", "radius", "parts"))
    centres = index.centres

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The most that a member of each cluster can score, best clusters first."""
        for batch in batches:
            matrix = np.array(batch["qdense"].tolist(), dtype=np.float64).reshape(len(batch), -1)
            lost = np.isnan(matrix).any(axis=1)
            matrix = np.where(lost[:, None], 0.0, matrix)
            reach = np.zeros((len(batch), len(number)))
            real = number >= 0
            if real.any():
                reach[:, real] = np.cos(np.maximum(0.0, _angles(matrix, centres[number[real]]) - radius[real] - SLACK))
            reach[~matrix.any(axis=1)] = 0.0
            reach[:, number == -2] = np.inf
            reach[lost] = np.inf
            order = np.argsort(-reach, axis=1, kind="stable")
            for q, best, r in zip(batch["qid"], order, reach):
                counted = np.where(number[best] == -2, 0, size[best])
                held = np.cumsum(counted) - counted
                yield pd.DataFrame({"qid": q, "cluster": number[best].astype("int32"), "reach": r[best], "n": size[best], "parts": parts[best], "seed": held < k})

    pairs = written(asked.select("qid", "qdense").mapInPandas(near, "qid long, cluster int, reach double, n long, parts int, seed boolean"), "reach")
    schema = StructType([*StructType.fromDDL("qid long"), index.vectors.schema[key], *StructType.fromDDL("score double")])
    arrow = to_arrow_schema(schema)
    columns = [key, "dense", *scope]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=arrow)
        batches = left.select(columns).combine_chunks().to_batches()
        return pa.Table.from_batches(list(_score_batches(batches, _Questions(right.to_pandas(), exact, optional), k, key)), schema=arrow)

    def scored(which: DataFrame) -> DataFrame:
        # Questions of a cluster are cut into groups, too, so that neither side of a meeting grows with the data.
        counts = which.groupBy("cluster").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("groups"))  # a row for each centre
        right = which.join(F.broadcast(counts), "cluster").withColumn("group", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("qid", "cluster", "part", "group").join(asked, "qid")
        left = index.vectors.join(F.broadcast(counts), "cluster").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        by = ["cluster", "part", "group"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, schema)

    first = written(scored(pairs.where("seed")), "first")
    kth = top_k(first, k, "qid", key, "score").groupBy("qid").agg(F.count("*").alias("_n"), F.min("score").alias("_k"))
    bound = kth.where(F.col("_n") >= k).select("qid", (F.col("_k") - 1e-8).alias("bound"))
    more = pairs.where("not seed").join(bound, "qid", "left").where(F.col("bound").isNull() | (F.col("reach") >= F.col("bound")) | (F.col("reach") == float("inf")))
    more = written(more.select("qid", "cluster", "n", "parts"), "more")
    hits = top_k(first.unionByName(scored(more)), k, "qid", key, "score", "dense_rank")
    return Found(hits, pairs.where("seed").select("qid", "cluster", "n").unionByName(more.select("qid", "cluster", "n")))
