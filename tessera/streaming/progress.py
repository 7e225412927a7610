"""Job progress as a stream: an appended log, the state of each job, and job expiry."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import constants as K
from tessera.sources import tables
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, done, last_ts), updated with each batch by a built-in stateful aggregation."""
    at = F.when(F.coalesce(F.col("state"), F.lit("")) != "", F.struct("ts", "seq"))
    return events.groupBy("job_id").agg(
        F.coalesce(F.max_by("state", at), F.lit("queued")).alias("status"),
        F.coalesce(F.bool_or(F.col("state").isin(K.TERMINAL_STATES)), F.lit(False)).alias("done"),
        F.max("ts").alias("last_ts"),
    )


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Start appending events to a log partitioned by day, for cursor readers and retention jobs."""
    return (
        events.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def expired_jobs(events: DataFrame, max_age_seconds: int = K.JOB_MAX_AGE_SECONDS, delay: str = "1 hour") -> DataFrame:
    """(job_id, created_at): each finished job once, when event time passes its creation by the maximum age."""
    watermarked = events.select("job_id", "ts", "state").withWatermark("ts", delay)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            created, done = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "created_at": [pd.Timestamp(created, unit="us")]})
            return
        created, done = state.get if state.exists else (None, False)
        for batch in batches:
            first = int(batch["ts"].min().value // 1000)
            created = first if created is None else min(created, first)
            done = done or bool(batch["state"].isin(K.TERMINAL_STATES).any())
        state.update((created, done))
        if done:
            due = created // 1000 + max_age_seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return watermarked.groupBy("job_id").applyInPandasWithState(
        step, "job_id string, created_at timestamp", "created long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


BUCKETS = 64
_BUCKET = ["bucket"]


def _folded(events: DataFrame, folder: str, name: str, ddl: str, summed: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame],
            closed: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, buckets: int = BUCKETS) -> str:
    """Folds a stream into a table of one row per job, a micro-batch at a time; the path of the table.

    `summed` maps a batch to rows of the table, `merged` brings rows of one job together; it must not mind rows that come
    twice.  Jobs are dealt into buckets, and a batch reads and writes those of its own jobs alone.  `closed` parts rows into
    those that stay and those whose life is over; these move to the table `<name>_closed`, in a folder for each batch.
    """
    spark = events.sparkSession
    table = os.path.join(folder, name)
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("string")

    def fold(batch: DataFrame, batch_id: int) -> None:
        rows = summed(batch).persist()
        try:
            batch.agg(F.max("ts").alias("clock")).write.mode("overwrite").parquet(f"{folder}/{name}_clock/batch={batch_id}")
            keys = rows.select(bucket.alias("bucket")).distinct()
            held = tables.read_table(spark, table, ddl, keys, _BUCKET)
            now = merged(held.unionByName(rows))
            if closed is not None:
                now, over = closed(now)
                over.write.mode("overwrite").parquet(f"{folder}/{name}_closed/batch={batch_id}")
            tables.replace_partitions(now.withColumn("bucket", bucket), table, _BUCKET, keys)
        finally:
            rows.unpersist()

    (events.writeStream.foreachBatch(fold).option("checkpointLocation", os.path.join(folder, f"{name}_checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    return table


STATES = "job_id string, at struct<ts:timestamp,seq:bigint>, state string, done boolean, last_ts timestamp"


def job_table(events: DataFrame, folder: str) -> DataFrame:
    """(job_id, status, done, last_ts) of every job, as `job_states` gives it, from a table that each batch brings up to date.

    Nothing is kept in the stream, however long it runs and however late an event comes.
    """
    at = F.when(F.coalesce(F.col("state"), F.lit("")) != "", F.struct(F.col("ts"), F.col("seq").cast("long").alias("seq")))

    def summed(batch: DataFrame) -> DataFrame:
        return batch.groupBy("job_id").agg(
            F.max(at).alias("at"), F.max_by("state", at).alias("state"),
            F.coalesce(F.bool_or(F.col("state").isin(K.TERMINAL_STATES)), F.lit(False)).alias("done"), F.max("ts").alias("last_ts"))

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("job_id").agg(F.max("at").alias("at"), F.max_by("state", "at").alias("state"), F.bool_or("done").alias("done"), F.max("last_ts").alias("last_ts"))

    table = _folded(events, folder, "states", STATES, summed, merged)
    return tables.read_table(events.sparkSession, table, STATES, partitions=_BUCKET).select("job_id", F.coalesce("state", F.lit("queued")).alias("status"), "done", "last_ts")


AGES = "job_id string, created_at timestamp, done boolean"


def job_expiry(events: DataFrame, folder: str, max_age_seconds: int = K.JOB_MAX_AGE_SECONDS, keep_seconds: int = 7 * 86400) -> DataFrame:
    """(job_id, created_at): each finished job whose creation lies `max_age_seconds` or more before the latest event, once.

    A job's row lives until `keep_seconds` after it expired and then moves to a table of closed jobs that no batch reads.  A
    late event counts whenever it comes: it makes or changes a row, and a job that was closed before is told apart when
    results are read, so it is not announced again.
    """
    spark, done = events.sparkSession, F.col("state").isin(K.TERMINAL_STATES)
    clock_at = os.path.join(folder, "ages_clock")

    def clock():
        return F.lit(spark.read.parquet(clock_at).agg(F.max("clock")).first()[0])

    def old(seconds: int):
        return F.col("done") & (F.unix_seconds("created_at") + seconds <= F.unix_seconds(clock()))

    def summed(batch: DataFrame) -> DataFrame:
        return batch.groupBy("job_id").agg(F.min("ts").alias("created_at"), F.coalesce(F.bool_or(done), F.lit(False)).alias("done"))

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("job_id").agg(F.min("created_at").alias("created_at"), F.bool_or("done").alias("done"))

    def closed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        over = F.coalesce(old(max_age_seconds + keep_seconds), F.lit(False))
        return rows.where(~over), rows.where(over)

    table = _folded(events, folder, "ages", AGES, summed, merged, closed)
    held = tables.read_table(spark, table, AGES, partitions=_BUCKET)
    gone = spark.read.schema(AGES).parquet(os.path.join(folder, "ages_closed"))
    return merged(held.unionByName(gone.select(*held.columns))).where(old(max_age_seconds)).select("job_id", "created_at")
