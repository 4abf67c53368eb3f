"""Counts over streams of events: windows with late rows, and messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts per window and keys; rows later than ``late`` behind the newest are left out of a stream."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(time_col, late)
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(events: DataFrame, time_col: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(time_col, late)
    return timed.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def deliver_once(messages: DataFrame, key: str, time_col: str, late: str = "1 day") -> DataFrame:
    """Of a stream of deliveries the first of each identifier; state older than the watermark is given up."""
    timed = messages.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
