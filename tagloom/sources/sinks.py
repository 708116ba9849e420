"""Writing results: Parquet, URL lists, tag maps, cached tables and comma-joined tags."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.generations import Generations


def through_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write a result and read it back, so that what follows starts from the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def urls(df: DataFrame) -> DataFrame:
    """The URLs of posts that have one, in the order of df."""
    return df.where(F.col("file_url").isNotNull()).select("file_url")


def write_urls(df: DataFrame, path: str) -> None:
    """One URL on a line; a sorted df keeps its order over the part files."""
    urls(df).write.mode("overwrite").text(path)


def tag_map_rows(tag_map: DataFrame) -> DataFrame:
    """(tag, category, count, coverage_percent) with four decimals."""
    return tag_map.select("tag", "category", "count", F.format_string("%.4f", "coverage").alias("coverage_percent"))


def write_tag_map(tag_map: DataFrame, path: str) -> None:
    tag_map_rows(tag_map).write.mode("overwrite").csv(path, header=True)


def joined_tags(tags: DataFrame) -> DataFrame:
    """One row: all tags of a bounded view, the most frequent first, joined by commas."""
    pair = F.struct((-F.col("count")).alias("n"), F.col("tag"))
    return tags.agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["tag"]), ", ").alias("tags"))


def save_tables(tables: Mapping[str, DataFrame], path: str, key: str | None = None) -> None:
    """Replace the tables kept at a path, all at once: one that is read meanwhile, or whose save is
    killed, is as it was. ``key`` tells what they were made from; see generations.source_key()."""
    spark = next(iter(tables.values())).sparkSession
    Generations(spark, path).save(tables, key)


def load_tables(spark: SparkSession, path: str, schemas: Mapping[str, str], key: str | None = None) -> dict[str, DataFrame] | None:
    """The tables written by save_tables; None if one is missing or lacks a column, or if they have another key."""
    return Generations(spark, path).load(schemas, key)


def write_dictionary(tags: DataFrame, counts: DataFrame, path: str) -> DataFrame:
    """The dictionary with fresh counts (0 for tags without posts), written and returned."""
    fresh = refreshed(tags, counts)
    fresh.write.mode("overwrite").parquet(path)
    return fresh


def refreshed(tags: DataFrame, counts: DataFrame) -> DataFrame:
    return tags.drop("count").join(counts.select("tag", "count"), "tag", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def scratch(spark: SparkSession) -> str:
    """A new folder for files, which the driver deletes when it ends: below the shared one that spark.checkpoint.dir
    names; in local mode without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tagloom-")
    folder = f"{root.rstrip('/')}/tagloom/files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
