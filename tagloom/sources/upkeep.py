"""Counts of tags that are kept up as files of posts arrive: each arrival is read alone.

The store has one generation for each arrival, with three tables.

- ``seen``: the keys of the posts that counted (md5, or the id where there is none), as 128 bits in two numbers.
- ``tags``: (tag, place, doy, ym, n), the arrival's occurrences of tags by category, day of the leap year and month.
- ``months``: (ym, n), its dated posts.

An arrival first drops posts whose key an earlier one has, in a join of keys alone, then keeps one post for
each key, that with the smallest id. Counts are sums, so those of several generations
merge by adding, and the totals, the seasonal counts and the dictionary's counts all follow from
them. A generation counts once its manifest is written; an arrival that fails leaves the store as it was.

Defined cases. Posts with neither md5 nor id all count. A post that came before keeps its first tags and
date. An arrival without new posts adds an empty generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.model import CATEGORIES, column_of
from tagloom.operators import seasonality
from tagloom.sources import sinks
from tagloom.sources.generations import Generations
from tagloom.sources.posts import conform

SCHEMAS = {"seen": "high long, low long", "tags": "tag string, place int, doy int, ym string, n long", "months": "ym string, n long"}


def post_key() -> Column:
    """What tells posts apart: md5, or the id where there is none; null without either."""
    return F.coalesce(F.nullif("md5", F.lit("")), F.nullif("id", F.lit(0)).cast("string"))


class CountStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.kept = spark, Generations(spark, root)

    def _table(self, name: str, generations: list[str]) -> DataFrame:
        if not generations:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(self.kept.path(g, name) for g in generations))

    def add(self, posts: DataFrame) -> None:
        """Count an arrival; only its posts and the keys of earlier ones are read. The posts are read three times, so a costly
        query should be written first. What is counted is written once, and both tables follow from it."""
        now, made = self.kept.current(), self.kept.new()
        key = post_key()
        hashed = F.md5(key.cast("binary"))
        half = lambda start: F.conv(F.substring(hashed, start, 16), 16, -10).cast("long")
        rows = conform(posts).select("id", "md5", "created_at", *(column_of(c) for c in CATEGORIES))
        named = rows.withColumn("high", half(1)).withColumn("low", half(17))
        keys = named.where("high is not null").select("high", "low").distinct()
        keys.join(self._table("seen", now["generations"]), ["high", "low"], "left_anti").write.parquet(self.kept.path(made, "seen"))
        fresh = named.join(self._table("seen", [made]), ["high", "low"], "left_semi").unionByName(named.where("high is null"))
        once = seasonality.distinct_posts(fresh.drop("high", "low"))
        written = self.kept.path(made, "counted")
        tags, dated = seasonality.parts_of(sinks.through_parquet(seasonality.counted_once(once), written))
        tags.write.parquet(self.kept.path(made, "tags"))
        dated.write.parquet(self.kept.path(made, "months"))
        self.kept.drop(made, "counted")
        self.kept.commit([*now["generations"], made], after=now["number"])

    def compact(self) -> None:
        """Merge all generations into one, so that reads open fewer files."""
        now, made = self.kept.current(), self.kept.new()
        self._table("seen", now["generations"]).write.parquet(self.kept.path(made, "seen"))
        self._table("tags", now["generations"]).groupBy("tag", "place", "doy", "ym").agg(F.sum("n").alias("n")).write.parquet(self.kept.path(made, "tags"))
        self.months().write.parquet(self.kept.path(made, "months"))
        self.kept.commit([made], after=now["number"])

    def tags(self) -> DataFrame:
        """(tag, place, doy, ym, n) of all arrivals."""
        return self._table("tags", self.kept.current()["generations"]).groupBy("tag", "place", "doy", "ym").agg(F.sum("n").alias("n"))

    def months(self) -> DataFrame:
        """(ym, n): dated posts of all arrivals."""
        return self._table("months", self.kept.current()["generations"]).groupBy("ym").agg(F.sum("n").alias("n"))

    def totals(self) -> DataFrame:
        """(tag, count): occurrences in all posts, as a dictionary takes them."""
        return self._table("tags", self.kept.current()["generations"]).groupBy("tag").agg(F.sum("n").alias("count"))

    def seasonal(self, min_posts: int = 1000) -> seasonality.Counts:
        """The counts that seasonal peaks are found in, without reading posts."""
        return seasonality.from_each(self._table("tags", self.kept.current()["generations"]), self.months(), min_posts)
