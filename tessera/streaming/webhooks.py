"""Repository webhooks as a stream: pushes change the chunk table, issue and pull-request events the graph.

All effects are keyed, and a path's last word is told by event time and delivery id, not by arrival.  So a delivery or a
micro-batch that comes twice, late or out of order leaves the same tables, and no state grows with the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import redact, routing
from tessera.operators import graph_git, maintenance
from tessera.plans.ingest import chunk_files, prepare_files
from tessera.session import written
from tessera.sources import tables


def stream_webhooks(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Webhook envelopes from JSON files; events of other kinds are ignored."""
    reader = spark.readStream.schema(schemas.WEBHOOKS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).where(F.col("event").isin("push", "pull_request", "issues"))


def push_changes(events: DataFrame, targets: DataFrame) -> DataFrame:
    """(user_id, is_public, repo, branch, path, action, ts, delivery_id): the last word on each path, per tenant.

    `targets` maps repo to its tenants.  Within one push removals come before additions, so a path
    that is both removed and added stays.  Added paths must be indexable.
    """
    pushes = events.where((F.col("event") == "push") & F.col("repository.full_name").isNotNull()
                          & F.col("repository.owner.login").isNotNull() & F.col("repository.name").isNotNull())
    none = F.array().cast("array<string>")
    listed = lambda field: F.flatten(F.transform(F.coalesce("commits", F.array().cast("array<struct<added:array<string>,modified:array<string>,removed:array<string>>>")), lambda c: F.coalesce(c[field], none)))
    marked = lambda array, action: F.transform(F.array_distinct(array), lambda p: F.struct(p.alias("path"), F.lit(action).alias("action")))
    changes = F.concat(marked(listed("removed"), "remove"), marked(F.concat(listed("added"), listed("modified")), "upsert"))
    rows = pushes.select(
        "ts", "delivery_id", F.col("repository.full_name").alias("repo"),
        F.substring_index(F.coalesce("ref", F.lit("")), "/", -1).alias("branch"), F.explode(changes).alias("c"),
    ).select("ts", "delivery_id", "repo", "branch", "c.path", "c.action")
    wanted = (F.col("action") == "remove") | routing.is_indexable(F.col("path"))
    last = maintenance.latest(rows.where(wanted), ["repo", "branch", "path"], "ts", "delivery_id", "action")
    return last.join(targets, "repo").select("user_id", "is_public", "repo", "branch", "path", "action", "ts", "delivery_id")


MARKS = "user_id string, is_public boolean, repo string, branch string, path string, action string, ts timestamp, delivery_id string"
_PLACE = ["user_id", "repo", "branch", "path"]


def newer_changes(changes: DataFrame, marks: DataFrame) -> DataFrame:
    """The changes that no mark, the last word applied to a path so far, is ahead of.  One that was applied comes again.  Marks
    are small as files and large in memory, so they are sorted, not sent to every task."""
    known = marks.select(*_PLACE, F.struct("ts", "delivery_id").alias("_m")).hint("merge")
    rows = changes.join(known, _PLACE, "left")
    return rows.where(F.col("_m").isNull() | (F.struct("ts", "delivery_id") >= F.col("_m"))).select(*changes.columns)


def _mark(changes: DataFrame, keys: DataFrame, mark_table: str) -> None:
    """Records the changes as applied, in the touched (tenant, repository, branch) partitions."""
    old = tables.read_table(changes.sparkSession, mark_table, MARKS, keys, tables.CHUNK_PARTITIONS)
    kept = old.join(changes.select(*_PLACE), _PLACE, "left_anti").select(*schemas.columns_of(MARKS))
    tables.replace_partitions(tables.with_chunk_partitions(kept.unionByName(changes)), mark_table, tables.CHUNK_PARTITIONS, keys)


def apply_pushes(changes: DataFrame, chunk_table: str, fetch: Callable[[DataFrame], DataFrame], run_id: str, run_seq: int, mark_table: str | None = None) -> None:
    """Bring the chunk table up to date with the changed paths; only the touched partitions are read and written.

    `fetch` maps changes (action upsert) to file rows with content.  With `mark_table` changes older than the last one applied
    to their path are left out.
    """
    spark = changes.sparkSession
    changes = changes.persist()
    try:
        keys = tables.with_chunk_partitions(changes).select(*tables.CHUNK_PARTITIONS).distinct()
        if mark_table is not None:
            newer = newer_changes(changes, tables.read_table(spark, mark_table, MARKS, keys, tables.CHUNK_PARTITIONS)).persist()
            changes.unpersist()
            changes = newer

        def merged(mine: DataFrame) -> DataFrame:
            kept = mine.join(changes.select("user_id", "repo", "branch", F.col("path").alias("file_path")),
                             ["user_id", "repo", "branch", "file_path"], "left_anti").select(*schemas.columns_of(schemas.CHUNKS))
            return maintenance.upsert_chunks(kept, chunk_files(prepare_files(fetch(changes.where(F.col("action") == "upsert"))), run_id, run_seq))

        tables.merge_chunks(spark, chunk_table, changes, merged)
        if mark_table is not None:
            _mark(changes, tables.with_chunk_partitions(changes).select(*tables.CHUNK_PARTITIONS).distinct(), mark_table)
    finally:
        changes.unpersist()


_RECORDS = {"issue": "issue", "pr": "pull_request"}


def record_rows(events: DataFrame, kind: str, targets: DataFrame, branch: str = "main") -> DataFrame:
    """Issue or pull-request records of a batch, redacted, one per tenant: the newest state of each number. With the columns of
    a mark; `path` is kind/number."""
    field = _RECORDS[kind]
    rows = events.where(F.col(field).isNotNull()).select(
        F.col("repository.full_name").alias("repo"), "ts", "delivery_id", F.col(f"{field}.*"))
    newest = maintenance.latest(rows, ["repo", "number"], "ts", "delivery_id")
    clean = redact.redact_fields(newest, ["title", "body"]).drop("secrets_redacted")
    path = F.concat(F.lit(f"{kind}/"), F.col("number").cast("string"))
    return clean.join(targets, "repo").withColumns({"branch": F.lit(branch), "path": path, "action": F.lit("upsert")})


def _touched(events: DataFrame, targets: DataFrame, branch: str = "main") -> DataFrame:
    """The (tenant, repository, branch) partitions of a batch's issues and pull requests."""
    held = F.lit(False)
    for field in _RECORDS.values():
        held = held | F.col(field).isNotNull()
    repos = events.where(held).select(F.col("repository.full_name").alias("repo")).distinct()
    return tables.with_chunk_partitions(repos.join(targets, "repo").withColumn("branch", F.lit(branch))).select(*tables.CHUNK_PARTITIONS).distinct()


def apply_records(events: DataFrame, node_table: str, edge_table: str, targets: DataFrame, mark_table: str | None = None) -> None:
    """Merge the graph of a batch's issues and pull requests into the node and edge tables; only the touched partitions are
    read and written.  With `mark_table` a record older than the last one applied to its number is left out, and one without a
    number.

    A batch is ranked once for each kind; what is left is written, and all else starts from there, so nothing is cached.  Joins
    here are such as spill, since a stream's batch may be large and its shuffle partitions few.
    """
    spark = events.sparkSession
    if mark_table is not None:
        places = written(_touched(events, targets), "places")
        marks = tables.read_table(spark, mark_table, MARKS, places, tables.CHUNK_PARTITIONS)
    records = {}
    for kind in _RECORDS:
        rows = record_rows(events, kind, targets)
        if mark_table is not None:
            rows = newer_changes(rows.where(F.col("path").isNotNull()), marks)
        records[kind] = written(rows, kind)
    issue_nodes, issue_edges = graph_git.issue_graph(records["issue"], once=True)
    no_files = tables.empty(spark, schemas.PR_FILES + ", user_id string, is_public boolean, repo string, branch string")
    pr_nodes, pr_edges = graph_git.pr_graph(records["pr"], no_files, once=True)
    new_nodes, new_edges = issue_nodes.unionByName(pr_nodes), issue_edges.unionByName(pr_edges)

    node_keys = written(tables.with_node_partitions(new_nodes).select(*tables.NODE_PARTITIONS).distinct(), "node_keys")
    held = tables.read_table(spark, node_table, schemas.NODES, node_keys, tables.NODE_PARTITIONS)
    merged = maintenance.merge_nodes(held, new_nodes, store=written)
    tables.replace_partitions(tables.with_node_partitions(merged), node_table, tables.NODE_PARTITIONS, node_keys)
    edge_keys = written(tables.with_edge_partitions(new_edges).select(*tables.EDGE_PARTITIONS).distinct(), "edge_keys")
    held = tables.read_table(spark, edge_table, schemas.EDGES, edge_keys, tables.EDGE_PARTITIONS)
    # Both ends of an edge lie in nodes of the tenant; those of other tenants are not opened.
    nodes = tables.read_table(spark, node_table, schemas.NODES, edge_keys.select("tenant"), tables.NODE_PARTITIONS)
    linked = maintenance.merge_edges(held, new_edges, nodes, store=written)
    tables.replace_partitions(tables.with_edge_partitions(linked), edge_table, tables.EDGE_PARTITIONS, edge_keys)
    if mark_table is not None:
        columns = schemas.columns_of(MARKS)
        changes = records["issue"].select(*columns).unionByName(records["pr"].select(*columns))
        _mark(changes, tables.with_chunk_partitions(changes).select(*tables.CHUNK_PARTITIONS).distinct(), mark_table)


def run_webhooks(events: DataFrame, checkpoint: str, targets: DataFrame, chunk_table: str, node_table: str, edge_table: str,
                 fetch: Callable[[DataFrame], DataFrame]):
    """Start the stream; every available file is processed, then the query ends."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            changes = push_changes(batch, targets)
            apply_pushes(changes, chunk_table, fetch, f"push-{batch_id}", batch_id + 1, f"{chunk_table.rstrip('/')}_marks")
            apply_records(batch, node_table, edge_table, targets, f"{node_table.rstrip('/')}_marks")
        finally:
            batch.unpersist()

    return (
        events.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
