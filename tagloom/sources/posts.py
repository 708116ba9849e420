"""Reading posts, tag dictionaries and aliases from loosely typed Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tagloom.model import NO_COLOR, POSTS_SCHEMA


def conform(df: DataFrame) -> DataFrame:
    """df with exactly the columns of a post: values that don't fit a type and columns that are
    missing are null."""
    have = {c: c for c in df.columns}
    return df.select([(F.col(have[f.name]).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in POSTS_SCHEMA])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def source_bytes(df: DataFrame) -> int:
    """The length of all files that a frame is read from; 0 where there are none. What is made of the frame is split by it."""
    conf, total = df.sparkSession._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def read_posts(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of the paths that exist, each conformed; FileNotFoundError if none does."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"no posts at {', '.join(paths)}")
    frames = [conform(spark.read.parquet(p)) for p in found]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def latest_date(*frames: DataFrame) -> DataFrame:
    """latest_date: the largest first ten characters of created_at, 2000-01-01 without any."""
    every = frames[0].select("created_at")
    for frame in frames[1:]:
        every = every.unionByName(frame.select("created_at"))
    return every.agg(F.coalesce(F.substring(F.max(F.nullif("created_at", F.lit(""))), 1, 10), F.lit("2000-01-01")).alias("latest_date"))


def read_dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """(tag, color, count) of the first path that can be read; a missing count is 0."""
    for path in paths:
        try:
            return dictionary(spark.read.parquet(path))
        except AnalysisException:
            continue
    raise FileNotFoundError(f"no dictionary at {', '.join(paths)}")


def dictionary(df: DataFrame) -> DataFrame:
    color = F.col("color").cast("string") if "color" in df.columns else F.lit(NO_COLOR)
    count = F.coalesce(F.col("count").try_cast("long"), F.lit(0)) if "count" in df.columns else F.lit(0)
    return df.select(F.col("tag").cast("string"), color.alias("color"), count.cast("long").alias("count"))


def with_aliases(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, display, tag, color, count): every tag of the dictionary under its own name, and
    under each alias whose target is in it."""
    own = tags.select(F.lower("tag").alias("key"), F.col("tag").alias("display"), "tag", "color", "count")
    pairs = aliases.select("alias", "tag").join(tags, "tag")
    return own.unionByName(pairs.select(F.lower("alias").alias("key"), F.concat("alias", F.lit(" → "), "tag").alias("display"), "tag", "color", "count"))
