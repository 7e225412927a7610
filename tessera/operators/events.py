"""Progress logs, job state, history windows, tool traces, daily quotas.

A job's events may be a large share of all rows, so nothing here numbers a whole job in one task:
positions come from the per-job total and a pruned rank from the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.routing import summarize_output, trace_kind


def retained_events(events: DataFrame, order: list[str], keep: int) -> DataFrame:
    """The last `keep` events per job with their 0-based position, and the job's offset and total."""
    totals = events.groupBy("job_id").agg(F.count("*").alias("total"))
    newest = Window.partitionBy("job_id").orderBy(*[F.col(c).desc() for c in order])
    tail = events.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= keep)
    return (
        tail.join(totals, "job_id")
        .withColumn("position", F.col("total") - F.col("_back"))
        .withColumn("offset", F.greatest(F.col("total") - keep, F.lit(0)))
        .drop("_back")
    )


def job_status(events: DataFrame, order: list[str]) -> DataFrame:
    """(job_id, status, done): last non-empty state; done once any terminal state was seen."""
    at = F.when(F.coalesce(F.col("state"), F.lit("")) != "", F.struct(*order))
    return events.groupBy("job_id").agg(
        F.coalesce(F.max_by("state", at), F.lit("queued")).alias("status"),
        F.coalesce(F.bool_or(F.col("state").isin(K.TERMINAL_STATES)), F.lit(False)).alias("done"),
    )


def events_since(events: DataFrame, cursors: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, heads) for readers at (job_id, cursor).

    rows: all events at or after the cursor, by their 0-based position in the job.  heads: new cursor and done flag per
    reader; a job nobody has heard of is `lost` and done.  `order` is a time and a tie-break.
    """
    numbered = number_in_time(events, "job_id", order, "position")
    rows = cursors.join(numbered, "job_id").where(F.col("position") >= F.col("cursor"))
    totals = events.groupBy("job_id").agg(F.count("*").alias("new_cursor"))
    heads = (
        cursors.join(totals, "job_id", "left").join(job_status(events, order), "job_id", "left")
        .withColumn("lost", F.col("new_cursor").isNull())
        .withColumns({
            "new_cursor": F.coalesce("new_cursor", "cursor"),
            "done": F.coalesce("done", F.lit(True)),
            "message": F.when(F.col("lost"), F.concat(
                F.lit(K.LOST_JOB_MESSAGE + " Job id: "), F.col("job_id"), F.lit("."))),
        })
    )
    return rows, heads


def live_jobs(jobs: DataFrame, now: Column, max_age_seconds: int = K.JOB_MAX_AGE_SECONDS) -> DataFrame:
    """Jobs that have not expired: a finished job goes `max_age_seconds` after its creation, counted in seconds of the clock, so
    fractions of a second do not matter."""
    age = F.timestamp_diff("SECOND", F.date_trunc("SECOND", F.col("created_at")), F.date_trunc("SECOND", now))
    return jobs.where(~(F.col("done") & (age > max_age_seconds)))


def latest_per_stage(events: DataFrame, order: list[str], shown: int | None = None) -> DataFrame:
    """The latest event of each stage; with `shown`, only that many newest ones per job."""
    last = Window.partitionBy("job_id", "stage").orderBy(*[F.col(c).desc() for c in order])
    per_stage = events.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1)
    if shown is None:
        return per_stage.drop("_n")
    newest = Window.partitionBy("job_id").orderBy(*[F.col(c).desc() for c in order])
    return per_stage.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= shown).drop("_n")


def recent_history(messages: DataFrame, conv: str, order: str, keep: int) -> DataFrame:
    """The last `keep` messages of each conversation; place 0 is the oldest kept."""
    newest = Window.partitionBy(conv).orderBy(F.col(order).desc())
    tail = messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= keep)
    oldest_first = Window.partitionBy(conv).orderBy(order)
    return tail.withColumn("place", F.row_number().over(oldest_first) - 1).drop("_back")


def number_in_time(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """0-based position of each row within its key by (time or number, tie-break); hours, or ten thousands, are numbered apart and shifted by the sizes of
    earlier ones, so a key with very many rows spreads over tasks."""
    numeric = rows.schema[order[0]].dataType.typeName() in ("integer", "long")
    cut = rows.withColumn("_b", F.floor(F.col(order[0]) / 10_000) if numeric else F.date_trunc("hour", F.col(order[0])))
    sizes = cut.groupBy(key, "_b").agg(F.count("*").alias("_s"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_s").over(before), F.lit(0))).select(F.col(key).alias("_k"), F.col("_b").alias("_h"), "_shift")
    local = cut.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1)
    both = local.join(shifts, (F.col(key) == F.col("_k")) & F.col("_b").eqNullSafe(F.col("_h")))
    return both.withColumn(out, F.col("_n") + F.col("_shift")).drop("_b", "_n", "_shift", "_k", "_h")


def number_rows(rows: DataFrame, key: str, order: str, out: str, block: int = 10_000) -> DataFrame:
    """1-based position of each row within its key by an integer order column that is unique in the key.

    Rows are numbered within blocks of the order value and shifted by the sizes of earlier blocks, so
    one key with very many rows spreads over tasks.
    """
    cut = rows.withColumn("_b", F.floor(F.col(order) / F.lit(block)))
    sizes = cut.groupBy(key, "_b").agg(F.count("*").alias("_s"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    local = cut.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)))
    return local.join(shifts, [key, "_b"]).withColumn(out, F.col("_n") + F.col("_shift")).drop("_b", "_n", "_shift")


def trace_steps(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv, step, kind, tool, input, summary): tool results with the call they answer.

    `calls`: conv, call_id, tool, input.  `results`: conv, call_id, seq (integer), name, content.
    A result without a call keeps its own name.
    """
    paired = results.join(calls, ["conv", "call_id"], "left")
    tool = F.coalesce(F.nullif("name", F.lit("")), "tool", F.lit("unknown_tool"))
    steps = number_rows(paired.withColumn("_tool", tool), "conv", "seq", "step")
    return steps.select(
        "conv", "step", trace_kind(F.col("_tool")).alias("kind"), F.col("_tool").alias("tool"),
        F.coalesce("input", F.lit("{}")).alias("input"), summarize_output(F.col("content")).alias("summary"),
    )


def quota_counts(requests: DataFrame, key: list[str], limit: int) -> DataFrame:
    """(*key, day, total, accepted, rejected) per UTC day; rejected requests still count."""
    days = requests.withColumn("day", F.to_date("ts")).groupBy(*key, "day").agg(F.count("*").alias("total"))
    return days.withColumns({
        "accepted": F.least("total", F.lit(limit)), "rejected": F.greatest(F.col("total") - limit, F.lit(0)),
    })


def over_quota(requests: DataFrame, key: list[str], order: list[str], limit: int) -> DataFrame:
    """Requests after the `limit`-th of their day.

    Only the limit-th request of each key and day is ranked out (pruned inside tasks); everything
    later than it is over the limit.
    """
    dated = requests.withColumn("day", F.to_date("ts"))
    nth = Window.partitionBy(*key, "day").orderBy(*order)
    slim = dated.select(*key, "day", *order)
    cut = slim.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= limit).where(F.col("_n") == limit)
    cut = cut.select(*key, "day", F.struct(*order).alias("_cut"))
    return dated.join(cut, [*key, "day"]).where(F.struct(*order) > F.col("_cut")).drop("_cut")
