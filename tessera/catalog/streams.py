"""Streaming jobs run over the given tables until nothing is left; batch SQL is the reference."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera import schemas
from tessera.catalog.registry import Inputs, query
from tessera.session import checkpoint_root, written
from tessera.sources import tables
from tessera.streaming import progress, quota, webhooks


def _stream(t: Inputs, table: str):
    """A table as a file stream."""
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


@query("quota_stream", """
SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS total, count(*) > 3 AS over_limit FROM events GROUP BY ALL""")
def quota_stream(t: Inputs):
    """The requests through files, a file a batch, the later half of the month first: the earlier half comes weeks late."""
    folder = os.path.join(checkpoint_root(t.spark), "requests", uuid.uuid4().hex)
    requests = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    late = F.coalesce(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), F.lit(True))
    for name, part in (("first", ~late), ("second", late)):
        requests.where(part).write.parquet(f"{folder}/in/{name}")
    stream = t.spark.readStream.schema(requests.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = quota.daily_totals(stream, ["user_id"], 3, folder)
    return done.withColumn("day", F.col("day").cast("string"))


@query("job_stream", """
SELECT 'job' || user_id AS job_id, arg_max(CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'running' END, (ts, event_id)) AS status,
  bool_or(event_type IN ('error', 'purchase')) AS done FROM events GROUP BY ALL""")
def job_stream(t: Inputs):
    state = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("running")
    events = _stream(t, "events").select(F.concat(F.lit("job"), "user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", state.alias("state"))
    return quota.settle(progress.job_states(events), ["job_id"]).select("job_id", "status", "done")


def _out_of_order(t: Inputs, rows, split: str, name: str, run, again: bool = False):
    """`run(stream, folder)` over rows as a file stream, a part a batch: those after `split` first, then the earlier ones, weeks
    late; with `again` the first part comes a second time.  Each part is written by many tasks and read by one start of the
    stream, which goes on from its checkpoint; what the last start gives is returned."""
    folder = os.path.join(checkpoint_root(t.spark), name, uuid.uuid4().hex)
    late = F.coalesce(F.col("ts") < F.lit(split).cast("timestamp"), F.lit(True))
    for part, which in (("1", ~late), ("2", late), *([("3", ~late)] if again else [])):
        rows.where(which).write.parquet(f"{folder}/in/{part}")
        stream = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        done = run(stream, folder)
    return done


_JOB_STATE = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'running' END"


def _jobs(t: Inputs):
    state = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("running")
    return t.events.select(F.concat(F.lit("job"), "user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), state.alias("state"))


@query("job_table", f"""
SELECT 'job' || user_id AS job_id, arg_max({_JOB_STATE}, (ts, event_id)) AS status, bool_or(event_type IN ('error', 'purchase')) AS done FROM events GROUP BY ALL""")
def job_table(t: Inputs):
    return _out_of_order(t, _jobs(t), "2024-01-16", "jobs", progress.job_table, again=True).select("job_id", "status", "done")


@query("expiry_stream", """
WITH j AS (SELECT 'job' || user_id AS job_id, min(ts) AS created, bool_or(event_type IN ('error', 'purchase')) AS done FROM events GROUP BY ALL)
SELECT job_id, floor(epoch(created))::BIGINT AS created FROM j WHERE done AND floor(epoch(created))::BIGINT + 2400000 <= (SELECT floor(epoch(max(ts)))::BIGINT FROM events)""")
def expiry_stream(t: Inputs):
    """Finished jobs older than four weeks less a bit; rows close a day after that, and the month's first half comes last."""
    expiry = lambda stream, folder: progress.job_expiry(stream, folder, 2400000, 86400)
    return _out_of_order(t, _jobs(t), "2024-01-16", "expiry", expiry, again=True).select("job_id", F.unix_seconds("created_at").alias("created"))


@query("record_stream", """
WITH x AS (SELECT 'u1::org/' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g') || '::main::issue::' || o_custkey AS id, o_orderkey, o_orderstatus, o_orderdate,
  row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, lpad(o_orderkey::VARCHAR, 12, '0') DESC) AS n FROM orders)
SELECT id, 'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS state FROM x WHERE n = 1""")
def record_stream(t: Inputs):
    """Orders as issue events, numbered by customer: the last word on a number goes by event time."""
    none, text = F.lit(None), F.lit(None).cast("string")
    user = F.struct(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("login"), F.lit("User").alias("type"))
    issue = F.struct(F.col("o_custkey").cast("int").alias("number"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
                     F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), text.alias("body"), text.alias("created_at"), user.alias("user"),
                     none.cast("array<struct<name:string>>").alias("labels"))
    whole = t.spark.createDataFrame([], schemas.WEBHOOKS)
    kind = {f.name: f.dataType for f in whole.schema}
    events = t.orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("delivery_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("issues").alias("event"),
        F.struct(_repo(), F.lit("n").alias("name"), F.struct(F.lit("org").alias("login")).alias("owner")).cast(kind["repository"]).alias("repository"),
        none.cast("string").alias("ref"), none.cast(kind["commits"]).alias("commits"), none.cast(kind["pull_request"]).alias("pull_request"), issue.cast(kind["issue"]).alias("issue"))
    targets = written(_targets(t), "targets")

    def run(stream, folder):
        def apply(batch, batch_id):
            webhooks.apply_records(batch, f"{folder}/nodes", f"{folder}/edges", targets, f"{folder}/marks")

        stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return folder

    folder = _out_of_order(t, events, "1995-01-01", "records", run, again=True)
    value = lambda k: F.try_element_at("props", F.lit(k))
    nodes = tables.read_table(t.spark, f"{folder}/nodes", schemas.NODES)
    return nodes.where("label = 'Issue'").select("id", value("title").alias("title"), value("state").alias("state"))


def _repo():
    return F.concat(F.lit("org/"), F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", "")).alias("repo")


def push_events(t: Inputs):
    """Orders as pushes to five repositories; a line's flag says whether its part was added, modified or removed."""
    t = t.wide
    path = F.concat(F.lit("parts/"), "l_partkey", F.lit(".py"))
    of = lambda flag: F.collect_list(F.when(F.col("l_returnflag") == flag, path))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.struct(of("N").alias("added"), of("A").alias("modified"), of("R").alias("removed")).alias("c"))
    repo = _repo()
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("delivery_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("push").alias("event"),
        F.struct(repo.alias("full_name"), F.lit("n").alias("name"), F.struct(F.lit("org").alias("login")).alias("owner")).alias("repository"),
        F.lit("refs/heads/main").alias("ref"), F.array("c").alias("commits"))


_PUSHED = """
WITH x AS (SELECT 'org/' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g') AS repo, 'parts/' || l_partkey || '.py' AS path, o_orderdate, o_orderkey,
  CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'upsert' END AS action FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT repo, path, action FROM x QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY o_orderdate DESC, o_orderkey DESC, action DESC) = 1"""


def _targets(t: Inputs):
    return t.orders.select(_repo()).distinct().withColumns({"user_id": F.lit("u1"), "is_public": F.lit(False)})


@query("push_changes", _PUSHED)
def push_changes(t: Inputs):
    return webhooks.push_changes(push_events(t), _targets(t)).select("repo", "path", "action")


@query("push_stream", _PUSHED)
def push_stream(t: Inputs):
    """The pushes through files, a part a batch, the later half first and all of it twice: the last word goes by event time."""
    targets = _targets(t)

    def run(stream, folder):
        def keep(batch, batch_id):
            changed = webhooks.push_changes(batch, targets)
            changed.write.mode("overwrite").parquet(f"{folder}/out/b={batch_id}")

        stream.writeStream.foreachBatch(keep).option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return folder

    folder = _out_of_order(t, push_events(t), "1995-01-01", "pushes", run, again=True)
    rows = t.spark.read.parquet(f"{folder}/out")
    return rows.groupBy("repo", "path").agg(F.max_by("action", F.struct("ts", "delivery_id", "action")).alias("action"))
