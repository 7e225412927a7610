"""JSON dumps of issues, pull requests, their files, and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues only; an issue list also carries pull requests, marked by a field of their own."""
    return without_pull_requests(spark.read.schema(schemas.ISSUES).json(path))


def without_pull_requests(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("pull_request").isNull())


def read_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PULL_REQUESTS).json(path)


def read_pr_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PR_FILES).json(path)


def read_commits(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """All commits, or the `newest` by author date."""
    commits = spark.read.schema(schemas.COMMITS).json(path)
    if newest is None:
        return commits
    return commits.orderBy(F.col("commit.author.date").desc(), F.col("sha")).limit(newest)
