"""Dedup and counts on a stream: an addition to the batch analyses.

A post counts once however often it arrives, as long as its copies' times lie within ``late`` of one
another: state for a key is held until the watermark passes its time by as much, so state is
bounded by what arrives within that time. On a batch frame all copies count once.

Defined cases. Rows without a key all count. Rows whose time is null, or lies before the watermark when they arrive, are
dropped by a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.tags import by_category


def distinct_rows(rows: DataFrame, key: Column, time_col: str, late: str = "2 days") -> DataFrame:
    """The rows with ``_at``, their time, one row for each key."""
    timed = rows.withColumn("_at", F.col(time_col).try_cast("timestamp"))
    own = timed.withColumn("_key", F.coalesce(F.concat(F.lit("="), key.cast("string")), F.uuid()))
    if rows.isStreaming:
        return own.withWatermark("_at", late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return own.dropDuplicates(["_key"]).drop("_key")


def distinct_counts(rows: DataFrame, key: Column, time_col: str, label: Column, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, label, count) of distinct rows in each window of time; a stream gives a window once it is closed."""
    once = distinct_rows(rows.withColumn("_label", label), key, time_col, late)
    counts = once.groupBy(F.window("_at", window).alias("w"), F.col("_label").alias("label")).agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("start"), "label", "count")


def tag_counts(posts: DataFrame, key: Column, late: str = "2 days") -> DataFrame:
    """(start, tag, category, count): occurrences of tags in distinct posts, by day."""
    once = distinct_rows(posts, key, "created_at", late).select("_at", F.explode(by_category()).alias("t"))
    counts = once.groupBy(F.window("_at", "1 day").alias("w"), F.col("t.tag").alias("tag"), F.col("t.category").alias("category")).agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("start"), "tag", "category", "count")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what a stream has now to Parquet files and return all that they hold; a later call
    with the same checkpoint goes on where this one ended."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
