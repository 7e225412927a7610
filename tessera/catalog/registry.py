"""Registered queries: a Spark callable plus, where plain SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import spread_small

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """An input derived from the given tables by SQL that Spark and the oracle both run.

    Other tables and views are written as {name}.
    """
    VIEWS[name] = sql


def _needed(sql: str) -> list[str]:
    return [n for n in [*TABLES, *VIEWS] if "{" + n + "}" in sql]


class Inputs:
    """Tables and views of one data folder, as frames."""

    def __init__(self, spark: SparkSession, folder: str, spread: bool = False):
        self.spark, self.folder, self._spread = spark, folder.rstrip("/"), spread

    @property
    def wide(self) -> Inputs:
        """The same inputs for costly per-row text work: tables of few splits use all cores."""
        return Inputs(self.spark, self.folder, spread=True)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            scan = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread_small(scan) if self._spread else scan
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in _needed(text)})


def _wide_integers(df: DataFrame) -> DataFrame:
    """Results use one integer width, like the SQL they are compared with."""
    narrow = {f.name: F.col(f"`{f.name}`").cast("long") for f in df.schema if f.dataType.simpleString() == "int"}
    return df.withColumns(narrow) if narrow else df


def query(name: str, oracle: str | None = None):
    """Register `fn(inputs) -> DataFrame`; the oracle names views as {view}."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: _wide_integers(fn(Inputs(spark, folder)))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def expand(sql: str) -> str:
    """Oracle text with the views it uses, directly or through others, as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _needed(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    plain = lambda text: text.format(**{n: n for n in [*TABLES, *VIEWS]})
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"
