"""Text artefacts (snapshots, health reports) keyed by kind, tenant, repository, branch and commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["kind", "user_id", "repo", "branch", "commit_sha"]


def fresh_artifacts(artifacts: DataFrame, now: Column, ttl_seconds: int | None) -> DataFrame:
    """The latest artefact per key that has not expired.  A missing commit counts as `unknown`."""
    keyed = artifacts.withColumn("commit_sha", F.coalesce(F.nullif("commit_sha", F.lit("")), F.lit("unknown")))
    if ttl_seconds is not None:
        keyed = keyed.where(F.timestamp_diff("SECOND", F.col("written_at"), now) < ttl_seconds)
    return keyed.groupBy(*KEY).agg(F.max(F.struct("written_at", "text")).alias("_a")).select(*KEY, "_a.text", "_a.written_at")


def lookup(requests: DataFrame, artifacts: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Each request with its artefact text, or the fallback (a column of the request)."""
    keyed = requests.withColumn("commit_sha", F.coalesce(F.nullif("commit_sha", F.lit("")), F.lit("unknown")))
    found = keyed.join(artifacts.select(*KEY, F.col("text").alias("_t")), KEY, "left")
    text = F.col("_t") if fallback is None else F.coalesce(F.col("_t"), fallback)
    return found.withColumn("text", text).withColumn("cached", F.col("_t").isNotNull()).drop("_t")


def append_artifact(artifacts: DataFrame, path: str) -> None:
    """Adds artefacts (kind, tenant, repository, branch, commit_sha, text, written_at) to a table partitioned by kind."""
    artifacts.write.mode("append").partitionBy("kind").parquet(path)
