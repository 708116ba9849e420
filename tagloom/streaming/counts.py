"""Incremental counts over a stream of events: an addition to the batch analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time_col: str, key_col: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, key, count) for each window of time. On a stream, events that are later than
    ``late`` are dropped and a window's counts come out once it is closed."""
    timed = events.withColumn("_at", F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if timed.isStreaming else timed
    counts = timed.groupBy(F.window("_at", window).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("start"), "key", "count")
