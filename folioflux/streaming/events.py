"""Windows over event streams: the same functions on a table and on a stream (readStream), there with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def hourly(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total by tumbling window."""
    grouped = _late(events, delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """user_id, start, n by session: events less than `gap` apart."""
    grouped = _late(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


def first_of_each(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """A stream without repeats of `keys` within the watermark; of a table the earliest row of each, by `ts` and then all
    columns."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys and c != "ts"]
    return events.groupBy(*keys).agg(F.min(F.struct("ts", *rest)).alias("_e")).select(*[F.col(c) if c in keys else F.col(f"_e.{c}") for c in events.columns])


def stale(jobs: DataFrame, now: str, limit_minutes: int = 30) -> DataFrame:
    """Jobs still queued or processing after the limit, as failed."""
    return jobs.where(F.col("status").isin("queued", "processing") & (F.col("started_at") < F.lit(now).cast("timestamp") - F.make_interval(mins=F.lit(limit_minutes)))).withColumn("status", F.lit("failed"))
