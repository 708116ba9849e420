"""Histograms over years, months or days: gaps, shares, smoothing and comparison of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import UNIT_CHARS, date_unit, share
from tagloom.plans.query import parse

_STEP = {"Year": ("yyyy", "-01-01"), "Month": ("yyyy-MM", "-01"), "Day": ("yyyy-MM-dd", "")}


def histogram(posts: DataFrame, interval: str = "Month") -> DataFrame:
    """(unit, count): posts by the prefix of their date, in order."""
    unit = F.substring("created_at", 1, UNIT_CHARS[interval])
    return posts.where(F.col("created_at").isNotNull()).groupBy(unit.alias("unit")).agg(F.count("*").alias("count")).orderBy("unit")


class Totals:
    """Histograms of all posts, kept for each interval until close()."""

    def __init__(self, posts: DataFrame):
        self.posts, self.kept = posts, {}

    def __call__(self, interval: str = "Month") -> DataFrame:
        if interval not in self.kept:
            self.kept[interval] = histogram(self.posts, interval).persist()
        return self.kept[interval]

    def close(self) -> None:
        for kept in self.kept.values():
            kept.unpersist()
        self.kept.clear()


def without_gaps(counts: DataFrame, interval: str = "Month") -> DataFrame:
    """counts with every unit between the first and the last; left as it is if one is no date.
    The calendar is made of the counts' two ends alone, in one row."""
    shape, rest = _STEP[interval]
    day = F.try_to_date(F.concat("unit", F.lit(rest)), "yyyy-MM-dd")
    ends = counts.agg(F.min(day).alias("low"), F.max(day).alias("high"), F.count_if(day.isNull()).alias("odd"))
    every = ends.where("odd = 0").select(F.explode(F.sequence("low", "high", F.expr(f"interval 1 {interval.lower()}"))).alias("day"))
    calendar = every.select(F.date_format("day", shape).alias("unit"), F.lit(0).cast("long").alias("count"))
    return counts.select("unit", "count").unionByName(calendar).groupBy("unit").agg(F.sum("count").alias("count")).orderBy("unit")


def normalized(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(unit, count, total, percent): each unit's count in percent of the unit's total."""
    joined = counts.select("unit", "count").join(totals.select("unit", F.col("count").alias("total")), "unit", "left")
    total = F.coalesce("total", F.lit(0).cast("long"))
    return joined.select("unit", "count", total.alias("total"), share(F.col("count"), total).alias("percent")).orderBy("unit")


def smoothed(series: DataFrame, column: str, window: int = 7, unit: str = "unit") -> DataFrame:
    """The column as the mean of the last ``window`` units, fewer at the start. The window
    runs over one row for each unit of time, so one task holds the calendar and no more."""
    if window <= 1:
        return series
    last = Window.orderBy(unit).rowsBetween(-(window - 1), 0)
    return series.withColumn(column, F.avg(F.col(column).cast("double")).over(last))


def compare(posts: DataFrame, queries: dict[str, str], interval: str = "Month", date_from: str | None = None, date_to: str | None = None, conditions: dict[str, Column] | None = None) -> DataFrame:
    """(unit, total, one count for each query): all queries in one pass over the posts. An
    empty query counts nothing. queries: column name to query text."""
    days = posts
    if date_from:
        days = days.where(F.col("created_at") >= date_from)
    if date_to:
        days = days.where(F.col("created_at") <= date_to)
    days = days.withColumn("unit", date_unit(F.col("created_at"), interval)).where(F.col("unit").isNotNull())
    tests = conditions or {name: parse(text, safe_rating=True).condition() if text.strip() else F.lit(False) for name, text in queries.items()}
    counts = [F.count_if(test).alias(name) for name, test in tests.items()]
    return days.groupBy("unit").agg(F.count("*").alias("total"), *counts).orderBy("unit")


def compare_shares(comparison: DataFrame, names: list[str]) -> DataFrame:
    return comparison.select("unit", *(share(F.col(n), F.col("total")).alias(n) for n in names)).orderBy("unit")
