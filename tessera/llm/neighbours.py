"""Exact nearest neighbours by inner product, in blocks.

Queries and candidates are cut into blocks by a hash of the id; every query block meets every candidate block once, by an
equality join on the pair of blocks, so a task holds one tile. In a tile both sides are scaled to int8, one scale per
vector. With q = s(a + e), |e| <= 1/2 per component, the integer product gives the true one up to
s*t*(|a|_1 + |b|_1 + d/2)/2, so a candidate stays only if its upper bound reaches the k-th best lower bound; those are
computed again in double precision. Tiles hand on k rows per query, and heaps (ranked windows, pruned before the shuffle)
merge them. Nothing is lost: recall is 1 by construction.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids. Vectors of another
length than a query's are no candidates for it. Repeated ids are all candidates, but no row with the query's own id is; a
repeated query id asks with its smallest vector. Ties go to the smaller id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
BLOCK = 8192


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(float).tiny
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def tile(queries: np.ndarray, query_ids: np.ndarray, others: np.ndarray, ids: np.ndarray, k: int, strip: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best others in one tile."""
    dim = queries.shape[1]
    qa, qs = _scaled(queries)
    ca, cs = _scaled(others)
    qn, cn = np.abs(qa.astype(np.int32)).sum(1), np.abs(ca.astype(np.int32)).sum(1)
    wide = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # both exact for the integers met here
    right = ca.astype(wide).T
    out = []
    for a in range(0, len(queries), strip):
        b = min(a + strip, len(queries))
        near = (qa[a:b].astype(wide) @ right).astype(np.float64)
        near *= qs[a:b, None] * cs[None, :]
        slack = (qn[a:b, None] + cn[None, :] + dim / 2) * (0.5 * qs[a:b, None] * cs[None, :]) * (1 + 1e-9) + 1e-300
        own = query_ids[a:b, None] == ids[None, :]
        low = np.where(own, -np.inf, near - slack)
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(b - a, -np.inf)
        stays = ~own & (near + slack >= floor[:, None])
        rows, cols = np.nonzero(stays)
        scores = np.empty(len(rows))
        for c in range(0, len(rows), 1 << 16):
            scores[c : c + (1 << 16)] = np.sum(queries[a + rows[c : c + (1 << 16)]] * others[cols[c : c + (1 << 16)]], axis=1)
        order = np.lexsort((ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < k
        out.append((query_ids[a:b][rows[best]], ids[cols[best]], scores[best]))
    return tuple(map(np.concatenate, zip(*out)))


def _usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col("v")
    inf = F.lit(float("inf"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0))
    )


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def search(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` to each row of it for which `is_query` holds."""
    all_rows = _usable(vectors, id_col, vector)
    asked = _usable(vectors.where(is_query), id_col, vector).groupBy("id").agg(F.min("v").alias("v"))
    n_query, n_block = _blocks(asked.count(), query_block), _blocks(all_rows.count(), block)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    salt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = asked.select("id", "v", salt(n_query).alias("qb"), each(n_block, "cb"))
    right = all_rows.select("id", "v", salt(n_block).alias("cb"), each(n_query, "qb"))
    schema = "query_id long, vec_id long, score double"

    def run(asked: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(others):
            widths = others["v"].map(len).to_numpy()
            for dim, group in asked.groupby(asked["v"].map(len)):
                fit = others[widths == dim]
                if len(fit):
                    found.append(tile(np.stack(group["v"].to_numpy()), group["id"].to_numpy(), np.stack(fit["v"].to_numpy()), fit["id"].to_numpy(), k))
        ids, near, scores = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pd.DataFrame({"query_id": ids, "vec_id": near, "score": scores})

    tiles = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(run, schema)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
