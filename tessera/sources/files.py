"""Checkouts and file listings as `files` frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import content_sha


def read_checkout(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Every file under `root`: relative path, byte size, repaired UTF-8 text and its hash.

    With `max_bytes` larger files are left out by a filter on the length, before their bytes are read.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    uri = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    folder = "/" + base.split("://")[-1].lstrip("/") + "/"
    relative = F.substr(uri, F.lit(len(folder) + 1))
    return (
        raw.select(relative.alias("path"), F.col("length").alias("size"), text.alias("content"))
        .withColumn("file_sha", content_sha(F.col("content")))
    )


def read_listing(listing: DataFrame) -> DataFrame:
    """Tree listing rows that are files; the blob hash serves as the content hash."""
    return listing.where(F.col("type") == "blob").select("path", "size", F.col("sha").alias("file_sha"))


def repo_listing(repos: DataFrame) -> DataFrame:
    """Repository listing rows with defaults; unnamed rows are dropped."""
    return repos.where(F.coalesce(F.col("full_name"), F.lit("")) != "").select(
        "name",
        "full_name",
        F.coalesce(F.col("private"), F.lit(False)).alias("private"),
        "language",
        F.coalesce(F.col("stargazers_count"), F.lit(0)).alias("stars"),
        F.coalesce(F.nullif(F.col("default_branch"), F.lit("")), F.lit("main")).alias("default_branch"),
    )


def branch_listing(branches: DataFrame) -> DataFrame:
    return branches.where(F.coalesce(F.col("name"), F.lit("")) != "").select(
        "name", F.col("commit.sha").alias("commit_sha")
    )
