"""Rank fusion of dense and sparse hit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as K


def fuse(dense: DataFrame, sparse: DataFrame, k: int = K.DEFAULT_TOP_K, key: str = "chunk_id") -> DataFrame:
    """(qid, key, score, rank): sum of 1/(rank+60) over both lists.

    Equal scores keep the order of first appearance: dense hits by their rank, then sparse ones.
    Both inputs hold at most k rows per question, so every group here is bounded.
    """
    def part(df: DataFrame, rank: str) -> DataFrame:
        ranks = {"dense_rank": F.lit(None).cast("int"), "sparse_rank": F.lit(None).cast("int")}
        ranks[rank] = F.col(rank)
        return df.select("qid", key, *[v.alias(n) for n, v in ranks.items()])

    gain = lambda c: F.coalesce(1.0 / (F.col(c) + F.lit(float(K.FUSION_OFFSET))), F.lit(0.0))
    merged = (
        part(dense, "dense_rank")
        .unionByName(part(sparse, "sparse_rank"))
        .groupBy("qid", key)
        .agg(F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank"))
        .withColumn("score", gain("dense_rank") + gain("sparse_rank"))
    )
    order = Window.partitionBy("qid").orderBy(
        F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank")
    )
    return (
        merged.withColumn("rank", F.row_number().over(order) - 1)
        .where(F.col("rank") < k)
        .select("qid", key, "score", "rank")
    )
