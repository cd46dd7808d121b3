"""Burst alerts on a stream.

Events are counted per cell and day under a watermark, so a day comes once, after it is closed; later events are dropped by the count, as
its contract says. Each batch of closed days is appended to a history and scored by the batch operator over it and the days before, so
stream and batch give the same alerts. Both tables are written under the batch's number, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netfusion.operators.bursts import WINDOW_DAYS, Z_LIMIT, bursts, zscores


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """cell, day_start, n per tumbling day. events: ts (timestamp), cell."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "cell").agg(F.count("*").alias("n")).select("cell", F.col("window.start").alias("day_start"), "n")


def burst_alerts(events: DataFrame, base: str, history: str, alerts: str, checkpoint: str, delay: str = "1 day", limit: float = Z_LIMIT, window: int = WINDOW_DAYS) -> StreamingQuery:
    """Start the query. Closed days (cell, day from 1 at ``base``, n) go to ``history``, days over the limit to ``alerts``."""
    day = (F.datediff(F.col("day_start").cast("date"), F.lit(base).cast("date")) + 1).cast("int").alias("day")
    counts = daily_counts(events, delay).select("cell", day, "n")

    def score(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/epoch={epoch}")
        spark = batch.sparkSession
        closed = spark.read.schema("cell string, day int, n long").parquet(f"{history}/epoch={epoch}")
        first, last = closed.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return
        start = max(1, first - window)
        near = spark.read.schema("cell string, day int, n long, epoch long").parquet(history).where(F.col("day").between(start, last) & (F.col("epoch") <= epoch))
        scored = zscores(near.groupBy("cell", "day").agg(F.sum("n").alias("n")), start, last, window)
        bursts(scored, limit, window).where(F.col("day") >= first).write.mode("overwrite").parquet(f"{alerts}/epoch={epoch}")

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(score).start()
