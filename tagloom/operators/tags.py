"""Counting tags: per category, over all categories, around a tag.

Tags are counted as often as they occur, so one that stands twice in a post, or in two of its
category columns, counts twice.
"""

from __future__ import annotations

from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import has_tag, spaced_tags, tag_array
from tagloom.model import CATEGORIES, MIXED, RATINGS, UNKNOWN, column_of


def by_category(categories: tuple[str, ...] = CATEGORIES, cut=tag_array) -> Column:
    """array of (tag, category) over the category columns of a post: one pass over its row."""
    return F.concat(*(_labelled(cut(F.col(column_of(c))), c) for c in categories))


def _labelled(tags: Column, category: str) -> Column:
    return F.transform(tags, lambda t: F.struct(t.alias("tag"), F.lit(category).alias("category")))


def rating_distribution(posts: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in RATINGS.items() for x in pair))
    counts = posts.where(F.col("rating").isNotNull()).groupBy("rating").agg(F.count("*").alias("count"))
    return counts.select(F.coalesce(names[F.col("rating")], "rating").alias("rating"), "count").orderBy(F.desc("count"), "rating")


def top_tags(posts: DataFrame, category: str, n: int = 100) -> DataFrame:
    """(tag, count) of a category's most frequent tags."""
    tags = posts.select(F.explode(F.split(column_of(category), " ")).alias("tag")).where("tag <> ''")
    return tags.groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag").limit(n)


def tag_counts(posts: DataFrame, empty: bool = False) -> DataFrame:
    """(tag, count) over the tag strings, most frequent first; with empty, what stands between single
    spaces, the empty tokens too."""
    listed = F.split("tag_string", " ") if empty else tag_array(F.col("tag_string"))
    tags = posts.select(F.explode(listed).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag")


def labelled_tags(posts: DataFrame) -> Column:
    """array of (tag, category) of a post: by its category columns, or of tag_string without any."""
    present = tuple(c for c in CATEGORIES if column_of(c) in posts.columns)
    return by_category(present, spaced_tags) if present else _labelled(spaced_tags(F.col("tag_string")), UNKNOWN)


def all_tags(posts: DataFrame, n_posts: int | None = None) -> DataFrame:
    """(tag, category, count, coverage) of every tag. A tag of several categories is mixed;
    coverage is the count in percent of the posts and may exceed 100. Frames without
    category columns are counted by tag_string, as unknown."""
    pairs = posts.select(F.explode(labelled_tags(posts)).alias("p")).select("p.tag", "p.category")
    # in two steps: the least of a string needs a sort, which is then of the few counts and not of all occurrences
    each = pairs.groupBy("tag", "category").agg(F.count("*").alias("n"))
    counts = each.groupBy("tag").agg(F.sum("n").alias("count"), F.min("category").alias("low"), F.max("category").alias("high"))
    category = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(MIXED)
    total = posts.agg(F.count("*")).scalar() if n_posts is None else F.lit(n_posts)
    return counts.select("tag", category.alias("category"), "count", (F.col("count") / F.greatest(F.lit(1), total) * 100.0).alias("coverage"))


def tag_map(posts: DataFrame, top_n: int = 5000, focus: str = "") -> DataFrame:
    """The most frequent tags; with a focus, those of the posts that have it, without itself."""
    if focus:
        return ranked(all_tags(posts_with(posts, focus)), top_n).where(F.col("tag") != focus).orderBy(F.desc("count"), "tag")
    return ranked(all_tags(posts), top_n)


def occurrences(posts: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(tag, category) of every tag in the category columns of posts."""
    return posts.select(F.explode(by_category(categories, spaced_tags)).alias("p")).select("p.tag", "p.category")


def most_frequent(pairs: DataFrame, n: int, buckets: int = 1 << 16) -> DataFrame:
    """(tag, category, count) of the n most frequent tags of (tag, category), exactly, without counting the others.

    A first pass counts hash buckets of tags, which bounds the count of every tag in them. The tags of
    the fullest buckets are counted; the n-th of these counts is a bound that the n-th tag of all
    reaches. Only buckets that reach it can hold a tag that belongs to the result, so the last pass
    counts the tags of those alone. The driver sees at most a number for each bucket, and broadcast
    are bucket numbers."""
    spark = pairs.sparkSession
    bucket = F.pmod(F.xxhash64("tag"), F.lit(buckets)).cast("int").alias("bucket")
    placed = pairs.select("tag", "category", bucket)
    held = placed.groupBy("bucket").agg(F.count("*").alias("most")).orderBy(F.desc("most"), "bucket").toArrow()  # one row for each bucket

    def within(rows) -> DataFrame:
        chosen = spark.createDataFrame(rows.select(["bucket"]))
        counted = placed.join(F.broadcast(chosen), "bucket", "left_semi").groupBy("tag").agg(F.count("*").alias("count"), F.min("category").alias("low"), F.max("category").alias("high"))
        return counted.select("tag", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(MIXED).alias("category"), "count")

    if not held.num_rows:
        return pairs.limit(0).select("tag", "category", F.lit(0).cast("long").alias("count"))
    bound = ranked(within(held.slice(0, 2 * n)), n).agg(F.min("count").alias("least"), F.count("*").alias("tags")).first()
    least = bound["least"] if bound["tags"] == n else 0
    return ranked(within(held.filter(pc.greater_equal(held["most"], least))), n)


def ranked(tags: DataFrame, n: int) -> DataFrame:
    return tags.orderBy(F.desc("count"), "tag").limit(n)


def has_focus(posts: DataFrame, tag: str) -> Column:
    """Whether a post has a tag in tag_string, or in its category columns without one."""
    if "tag_string" in posts.columns:
        return has_tag(F.col("tag_string"), tag)
    present = [column_of(c) for c in CATEGORIES if column_of(c) in posts.columns]
    return has_tag(F.concat_ws(" ", *present), tag) if present else F.lit(False)


def posts_with(posts: DataFrame, tag: str) -> DataFrame:
    return posts.where(has_focus(posts, tag))


def visible(tags: DataFrame, text: str = "", category: str | None = None, min_count: int = 0) -> DataFrame:
    """The rows of a tag map whose name contains a text, of a category, with a least count."""
    tests = [F.col("count") >= min_count]
    if text:
        tests.append(F.contains(F.lower("tag"), F.lit(text.lower())))
    if category:
        tests.append(F.col("category") == category)
    return tags.where(reduce(Column.__and__, tests))


def tag_links(tags: DataFrame, base: str) -> DataFrame:
    """(tag, url): where the posts of a tag can be seen; the tag is percent-encoded."""
    return tags.select("tag", F.concat(F.lit(f"{base}/posts?tags="), F.url_encode("tag")).alias("url"))


def summary(tags: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: total and visible tags, and the category with most visible tags."""
    per = shown.groupBy("category").agg(F.count("*").alias("n"))
    top = per.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("visible"), F.max(F.struct("n", "category"))["category"].alias("top_category"))
    return top.select(tags.agg(F.count("*")).scalar().alias("total"), "visible", "top_category")
