"""Tags that peak at the same time of every year.

One row for each tag holds its counts by day of the leap year and by month, both bounded by the
calendar. Peaks are found within that row: the days become a dense array, its running sums
give every window going round the year, and the years are summed from the months. So from the
scan to the peaks there is one plan without joins, whatever the number of tags.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import color_of, day_of_leap_year, glob_pattern, leap_label, year_month
from tagloom.model import CATEGORIES, column_of
from tagloom.operators.tags import by_category

DAYS = 366


@dataclass(frozen=True)
class PeakSpec:
    window: int = 30
    min_score: float = 1.8
    max_peak_share: float = 0.5
    min_recurrence: int = 3
    categories: tuple[str, ...] = CATEGORIES
    search: str = ""


@dataclass
class Counts:
    """tags(tag, category, days, months), days an array of (doy, n) and months one of (ym, n); and
    all_months(ym, n). days, months and categories give the same as rows."""

    tags: DataFrame
    all_months: DataFrame

    @property
    def days(self) -> DataFrame:
        return self.tags.select("tag", F.inline("days"))

    @property
    def months(self) -> DataFrame:
        return self.tags.select("tag", F.inline("months"))

    @property
    def categories(self) -> DataFrame:
        return self.tags.select("tag", "category")

    @staticmethod
    def of(days: DataFrame, months: DataFrame, all_months: DataFrame, categories: DataFrame) -> Counts:
        """From tables of rows, as they are kept in files."""
        by_month = months.groupBy("tag").agg(F.collect_list(F.struct("ym", "n")).alias("months"))
        return Counts(categories.join(in_rows(days), "tag").join(by_month, "tag").select("tag", "category", "days", "months"), all_months)

    def keep(self) -> Counts:
        """Hold the counts for several uses, until close()."""
        self.tags.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def close(self) -> None:
        self.tags.unpersist()


#: Of the tables that save_tables and load_tables keep.
CACHE = {"days": "tag string, doy int, n long", "months": "tag string, ym string, n long", "all_months": "ym string, n long", "categories": "tag string, category string"}


def distinct_posts(posts: DataFrame) -> DataFrame:
    """One post for each md5, or id where there is none; posts with neither all stay. A file's posts
    are reduced before the shuffle, so one with very many is no hot key."""
    key = F.coalesce(F.nullif("md5", F.lit("")), F.nullif("id", F.lit(0)).cast("string"))
    own = F.when(key.isNull(), F.monotonically_increasing_id())
    first = F.min_by(F.struct(*posts.columns), F.struct(F.col("id").isNull(), "id", "created_at"))
    return posts.groupBy(key.alias("_key"), own.alias("_own")).agg(first.alias("_post")).select("_post.*")


def count(posts: DataFrame, min_posts: int = 1000) -> Counts:
    """Counts of the tags with at least min_posts occurrences in distinct posts, dated or not."""
    once = distinct_posts(posts.select("id", "md5", "created_at", *(column_of(c) for c in CATEGORIES)))
    doy = day_of_leap_year(F.col("created_at"))
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("t.category")).cast("int")
    rows = once.select(doy.alias("doy"), F.when(doy.isNotNull(), year_month(F.col("created_at"))).alias("ym"), F.explode(by_category()).alias("t"))
    each = rows.groupBy(F.col("t.tag").alias("tag"), place.alias("place"), "doy", "ym").agg(F.count("*").alias("n"))
    every = once.where(doy.isNotNull()).groupBy(year_month(F.col("created_at")).alias("ym")).agg(F.count("*").alias("n"))
    return from_each(each, every, min_posts)


def counted(posts: DataFrame) -> DataFrame:
    """(tag, place, doy, ym, n) of distinct posts in one aggregate: occurrences of tags, and in rows without tag and place the
    posts themselves. To be written where several tables follow from it, which would each read the posts again."""
    once = distinct_posts(posts.select("id", "md5", "created_at", *(column_of(c) for c in CATEGORIES)))
    return counted_once(once)


def counted_once(once: DataFrame) -> DataFrame:
    """As counted(), of posts that are distinct."""
    doy = day_of_leap_year(F.col("created_at"))
    none = F.lit(None).cast("string")
    listed = F.concat(F.array(F.struct(none.alias("tag"), none.alias("category"))), by_category())
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("t.category")).cast("int")
    rows = once.select(doy.alias("doy"), year_month(F.col("created_at")).alias("ym"), F.explode(listed).alias("t"))
    month = F.when(F.col("doy").isNotNull(), F.col("ym")).alias("ym")
    return rows.groupBy(F.col("t.tag").alias("tag"), place.alias("place"), "doy", month).agg(F.count("*").alias("n"))


def parts_of(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """counted() as rows (tag, place, doy, ym, n) of tags and (ym, n) of dated posts."""
    every = counts.where("tag is null and doy is not null").groupBy("ym").agg(F.sum("n").alias("n"))
    return counts.where("tag is not null"), every


def from_each(each: DataFrame, every: DataFrame, min_posts: int = 1000) -> Counts:
    """Counts from rows (tag, place, doy, ym, n), which may repeat, and (ym, n) of all posts; place is the
    category's, from 1."""
    kind = lambda day, month, last: F.struct(day.alias("doy"), month.alias("ym"), F.lit(last).alias("is_month"))
    both = each.select("tag", "place", "n", F.explode(F.array(kind(F.col("doy"), F.lit(None).cast("string"), False), kind(F.lit(None).cast("int"), F.col("ym"), True))).alias("k"))
    summed = both.groupBy("tag", "k").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    dated = F.col("k.doy").isNotNull() | F.col("k.ym").isNotNull()
    tags = summed.groupBy("tag").agg(
        F.sum(F.when(~F.col("k.is_month"), F.col("n"))).alias("posts"),
        F.min(F.when(dated, F.col("place"))).alias("place"),
        F.collect_list(F.when(F.col("k.doy").isNotNull(), F.struct(F.col("k.doy").alias("doy"), "n"))).alias("days"),
        F.collect_list(F.when(F.col("k.ym").isNotNull(), F.struct(F.col("k.ym").alias("ym"), "n"))).alias("months"),
    )
    often = tags.where((F.col("posts") >= min_posts) & F.col("place").isNotNull())
    return Counts(often.select("tag", F.array(*map(F.lit, CATEGORIES))[F.col("place") - 1].alias("category"), "days", "months"), every)


def in_rows(days: DataFrame) -> DataFrame:
    """(tag, days) of rows (tag, doy, n)."""
    return days.groupBy("tag", "doy").agg(F.sum("n").alias("n")).groupBy("tag").agg(F.collect_list(F.struct("doy", "n")).alias("days"))


def name_matches(search: str) -> Column:
    """Whether a tag fits every glob of the search; those after a - must not fit."""
    tests = [~F.col("tag").rlike(glob_pattern(t[1:])) if t.startswith("-") else F.col("tag").rlike(glob_pattern(t)) for t in search.split()]
    return reduce(Column.__and__, tests, F.lit(True))


def with_windows(tags: DataFrame, width: int) -> DataFrame:
    """tags, whose rows have ``days``, with ``totals``: for each of the 366 days the posts on that day
    and the days after it, width days in all, going round the year."""
    if not 1 <= width <= DAYS:
        raise ValueError(f"a window has 1 to {DAYS} days")
    year = F.sequence(F.lit(0), F.lit(DAYS - 1))
    none = F.lit(0).cast("long")
    # each running sum is repeated up to the next day with posts; looking every day up in the list would read it 366 times
    held = tags.withColumn("_on", F.sort_array(F.filter("days", lambda x: x["doy"].between(0, DAYS - 1))))
    held = held.withColumn("_sums", F.aggregate("_on", F.array(none), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x["n"]))))
    held = held.withColumn("_ends", F.concat(F.array(F.lit(-1)), F.transform("_on", lambda x: x["doy"]), F.array(F.lit(DAYS))))
    ends = F.col("_ends")
    held = held.withColumn("_upto", F.flatten(F.transform("_sums", lambda n, i: F.array_repeat(n, ends[i + 1] - ends[i]))))
    upto = F.col("_upto")
    total = lambda d: F.when(d + width <= DAYS, upto[F.least(d + width, F.lit(DAYS))] - upto[d]).otherwise(upto[DAYS] - upto[d] + upto[F.greatest(d + (width - DAYS), F.lit(0))])
    return held.withColumn("totals", F.transform(year, total)).drop("_on", "_sums", "_ends", "_upto")


def ahead(days: DataFrame, width: int) -> DataFrame:
    """(tag, doy, total): the windows of rows (tag, doy, n), as rows."""
    return with_windows(in_rows(days), width).select("tag", F.posexplode("totals").alias("doy", "total"))


def with_densest(tags: DataFrame, window: int) -> DataFrame:
    """tags with best_doy, peak_posts and total_posts: the window of days, going round the year, with
    most posts; of several the one that starts first, on a day with posts or without."""
    best = with_windows(tags, window).withColumn("_best", F.array_max(F.transform("totals", lambda n, d: F.struct(n.alias("n"), (-d).alias("early")))))
    every = F.aggregate("days", F.lit(0).cast("long"), lambda sum_, d: sum_ + d["n"])
    # a generator, since conditions on its columns aren't computed again below it
    return best.select(*tags.columns, F.inline(F.array(F.struct((-F.col("_best.early")).alias("best_doy"), F.col("_best.n").alias("peak_posts"), every.alias("total_posts")))))


def densest(days: DataFrame, window: int) -> DataFrame:
    """(tag, best_doy, peak_posts, total_posts) of rows (tag, doy, n)."""
    return with_densest(in_rows(days), window).drop("days")


def peaks(counts: Counts, spec: PeakSpec = PeakSpec()) -> DataFrame:
    """(tag, category, color, peak_date, best_doy, w, score, peak_posts, bg_avg, max_peak_share,
    years_spiked, total_posts), best first."""
    w = spec.window
    named = counts.tags.where(F.col("category").isin(list(spec.categories)) & name_matches(spec.search))
    found = with_densest(named, w).where("total_posts > 0")
    rest = (F.col("total_posts") - F.col("peak_posts")) / F.lit(float(DAYS - w)) if w < DAYS else F.lit(0.0)
    found = found.withColumn("bg_avg", rest).withColumn("score", (F.col("peak_posts") / F.lit(float(w)) + F.lit(1e-5)) / (F.col("bg_avg") + F.lit(1e-5)))
    found = found.where(F.col("score") >= spec.min_score)
    month = lambda day: F.substring(leap_label(day), 1, 2)
    first, last = month(F.col("best_doy")), month(F.pmod(F.col("best_doy") + (w - 1), F.lit(DAYS)))
    near = found.withColumn("_first", first).withColumn("_last", last)
    near = near.withColumn("_near", F.filter("months", lambda m: F.substring(m["ym"], 6, 2).isin(F.col("_first"), F.col("_last"))))
    years = F.array_distinct(F.transform("_near", lambda m: F.substring(m["ym"], 1, 4)))
    zero = F.lit(0).cast("long")
    of_year = lambda y: F.aggregate(F.filter("_near", lambda m: F.substring(m["ym"], 1, 4) == y), zero, lambda sum_, m: sum_ + m["n"])
    near = near.withColumn("_years", years).withColumn("_each", F.transform("_years", of_year))
    near = near.withColumn("_most", F.array_max("_each")).withColumn("_sum", F.aggregate("_each", zero, lambda sum_, n: sum_ + n))
    spiked = F.size(F.filter("_each", lambda n: n >= F.col("_most") * 0.1)).cast("long")
    lasting = near.where("_sum > 0").select("tag", "category", "best_doy", "score", "peak_posts", "bg_avg", "total_posts", F.inline(F.array(F.struct((F.col("_most") / F.col("_sum")).alias("part"), spiked.alias("years_spiked")))))
    lasting = lasting.where((F.col("part") <= spec.max_peak_share) & (F.col("years_spiked") >= spec.min_recurrence))
    # dealt once more, few rows by then and not by tag as before: the sort first takes a sample of what it sorts, which would find all peaks twice
    return lasting.repartition("score").select(
        "tag", "category", color_of(F.col("category")).alias("color"), leap_label(F.col("best_doy") + w // 2).alias("peak_date"), "best_doy", F.lit(w).alias("w"), "score",
        "peak_posts", "bg_avg", (F.col("part") * 100.0).alias("max_peak_share"), "years_spiked", "total_posts",
    ).orderBy(F.desc("score"), "tag")


def heat(found: DataFrame) -> DataFrame:
    """(doy, tags): how many peaks cover each day of the year."""
    covered = found.select(F.explode(F.transform(F.sequence(F.col("best_doy"), F.col("best_doy") + F.col("w") - 1), lambda d: F.pmod(d, F.lit(DAYS)))).alias("doy"))
    every = found.sparkSession.range(DAYS).select(F.col("id").cast("int").alias("doy"))
    counts = covered.groupBy("doy").agg(F.count("*").alias("tags"))
    return every.join(F.broadcast(counts), "doy", "left").select("doy", F.coalesce("tags", F.lit(0).cast("long")).alias("tags")).orderBy("doy")


def heat_levels(days: DataFrame, column: str = "tags") -> DataFrame:
    """days with ``level``, 0 to 1 on a logarithmic scale between the least and the most."""
    every = Window.partitionBy()  # a year's days; two subqueries would find their peaks twice more
    low, high = F.min(column).over(every), F.max(column).over(every)
    above = F.log1p((F.col(column) - low).cast("double")) / F.log1p((high - low).cast("double"))
    return days.withColumn("level", F.when((high <= low) | (F.col(column) <= low), 0.0).otherwise(above))


def peaks_on(found: DataFrame, day: int) -> DataFrame:
    """The peaks whose window covers a day of the year."""
    return found.where(F.pmod(F.lit(day) - F.col("best_doy"), F.lit(DAYS)) < F.col("w"))


def ahead_mean(days: DataFrame, width: int = 7) -> DataFrame:
    """(tag, doy, mean): for every day of the year, the mean of it and the days after it."""
    return ahead(days, width).select("tag", "doy", (F.col("total") / F.lit(float(width))).alias("mean"))


def timeline(counts: Counts, tag: str) -> DataFrame:
    """(ym, n, percent): a tag's posts in every month from the first to the last of all posts,
    and in percent of that month's posts."""
    first = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    ends = counts.all_months.agg(first(F.min("ym")).alias("low"), first(F.max("ym")).alias("high"))
    every = ends.where("low is not null").select(F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("ym"))
    own = counts.months.where(F.col("tag") == tag).select("ym", F.col("n").alias("own"))
    joined = every.join(own, "ym", "left").join(counts.all_months, "ym", "left")
    n = F.coalesce("own", F.lit(0).cast("long"))
    return joined.select("ym", n.alias("n"), (n / F.greatest(F.lit(1).cast("long"), F.coalesce("n", F.lit(0).cast("long"))) * 100.0).alias("percent")).orderBy("ym")
