"""What changed between two runs of a branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_KEY = ["user_id", "repo", "branch", "path"]


def change_status(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current files with status new, changed or unchanged."""
    before = previous.where(F.col("path").isNotNull() & F.col("file_sha").isNotNull()).select(
        *FILE_KEY, F.col("file_sha").alias("_before")
    )
    status = (
        F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("file_sha"), "unchanged").otherwise("changed")
    )
    return current.join(before, FILE_KEY, "left").withColumn("status", status).drop("_before")


def removed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.select(*FILE_KEY).join(current.select(*FILE_KEY), FILE_KEY, "left_anti")


def unchanged_branches(heads: DataFrame, indexed: DataFrame) -> DataFrame:
    """Branches whose head commit is the indexed one; they need no work at all."""
    key = ["user_id", "repo", "branch"]
    return heads.join(indexed.select(*key, "commit_sha").distinct(), [*key, "commit_sha"], "left_semi")
