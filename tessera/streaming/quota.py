"""Daily request counts as a stream.

`daily_totals` counts every request.  `daily_counts` is the bounded view for dashboards: its watermark drops late requests.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_root


def daily_counts(requests: DataFrame, key: list[str], limit: int, delay: str = "1 day") -> DataFrame:
    """(*key, day, total, over_limit) per UTC day.

    The watermark bounds the state; requests later than `delay` are dropped by it and show up in the
    query's progress as rows dropped.  Where late requests must count, use `daily_totals`.
    """
    counts = requests.withWatermark("ts", delay).groupBy(*key, F.window("ts", "1 day")).agg(F.count("*").alias("total"))
    return counts.select(*key, F.to_date("window.start").alias("day"), "total", (F.col("total") > limit).alias("over_limit"))


def daily_totals(requests: DataFrame, key: list[str], limit: int, folder: str | None = None) -> DataFrame:
    """(*key, day, total, over_limit) per UTC day over everything available, however late a request comes.

    Each micro-batch writes its own counts to its own folder below the shared one, so a repeated batch replaces itself; a total
    is the sum over the batches.  Nothing is kept in the stream, so no watermark is needed.  With the same `folder` a later
    call goes on where the last one ended.
    """
    spark = requests.sparkSession
    folder = folder or os.path.join(checkpoint_root(spark), "totals", uuid.uuid4().hex)
    out = os.path.join(folder, "rows")
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86400).cast("int"))

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(*key, day.alias("day")).agg(F.count("*").alias("total"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).groupBy(*key, "day").agg(F.sum("total").alias("total"), (F.sum("total") > limit).alias("over_limit"))


def rows_dropped_late(query) -> int:
    """How many rows the watermark has dropped so far in the reported progress of a query."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def settle(updates: DataFrame, key: list[str], folder: str | None = None) -> DataFrame:
    """Run an update-mode stream over everything available and return the last row per key.

    Each micro-batch writes its updates to its own folder, so a repeated batch replaces itself.
    """
    spark = updates.sparkSession
    folder = folder or os.path.join(checkpoint_root(spark), "settled", uuid.uuid4().hex)
    out = os.path.join(folder, "rows")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        updates.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in [*key, "batch"]]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_l")).select(*key, "_l.*")
