"""Searching posts: query, filters, one post for each file, order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.query import Term, parse
from tagloom.sources.posts import source_bytes

BUCKET_BYTES = 32 << 20
SORTS = {"Score": "score", "Favorites": "fav_count", "Date": "created_at"}


@dataclass(frozen=True)
class SearchSpec:
    query: str = ""
    ratings: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    orientation: str | None = None
    min_score: int | None = None
    min_favs: int | None = None
    dedup: bool = False
    sort: str = "Score"
    descending: bool = True
    seed: int = 0

    def order(self) -> tuple[str, bool]:
        """(column, descending): the query's own order, or else the chosen one."""
        return parse(self.query).order or (SORTS[self.sort], self.descending)

    def conditions(self, tested: Callable[[Term], Column | None] = lambda term: None) -> list[Column]:
        """Dates compare as strings; a time of day on the last date lies beyond it. ``tested`` may give a
        term's test in another form."""
        width, height = F.col("image_width"), F.col("image_height")
        shapes = {"Landscape": width > height, "Portrait": width < height, "Square": width == height}
        tests = [parse(self.query).condition(tested)]
        if self.ratings:
            tests.append(F.col("rating").isin(list(self.ratings)))
        for bound, test in ((self.date_from, F.col("created_at").__ge__), (self.date_to, F.col("created_at").__le__), (self.min_score, F.col("score").__ge__), (self.min_favs, F.col("fav_count").__ge__)):
            if bound is not None:
                tests.append(test(bound))
        if self.orientation in shapes:
            tests.append(shapes[self.orientation])
        return tests


def matching(posts: DataFrame, spec: SearchSpec) -> DataFrame:
    return posts.where(reduce(Column.__and__, spec.conditions()))


def first_of_file(posts: DataFrame) -> DataFrame:
    """One post for each md5, that with the smallest id; all posts without md5 are one. A file's
    posts are reduced before the shuffle, so one with very many, or none, is no hot key."""
    first = F.min_by(F.struct(*posts.columns), F.struct(F.col("id").isNull(), "id", "created_at"))
    return posts.groupBy(F.col("md5").alias("_md5")).agg(first.alias("_post")).select("_post.*")


def write_by_file(posts: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """Keep posts as a table bucketed by md5, and return it: its posts of one file lie in one bucket. A bucket is read by
    one task, so there are more than ``buckets`` where the posts' files are longer than BUCKET_BYTES for each. Posts are dealt by bucket
    before, so a task writes one file; those without md5 stay dealt by id, or one task would sort them all."""
    buckets = max(buckets, -(-source_bytes(posts) // BUCKET_BYTES))
    dealt = posts.repartition(buckets, F.coalesce("md5", F.col("id").cast("string")))
    dealt.write.bucketBy(buckets, "md5").sortBy("md5", "id").option("path", path).mode("overwrite").saveAsTable(table)
    return posts.sparkSession.table(table)


def first_of_bucketed(table: DataFrame) -> DataFrame:
    """As first_of_file, for a table bucketed by md5: nothing is shuffled, and only ids are aggregated. Rows
    with their file's first id are found by a hash join within the bucket; several rows of one id
    are told apart by their dates and then by their other columns."""
    named = table.where(F.col("md5").isNotNull())
    least = named.groupBy("md5").agg(F.min("id").alias("_first"))
    last = F.lit((1 << 63) - 1)  # in place of null; not a key of the join, which the buckets would not have
    is_first = F.coalesce("id", last) <= F.coalesce("_first", last)
    near = named.join(least.hint("shuffle_hash"), "md5").where(is_first)
    ties = [F.asc_nulls_first(c) for c in ("created_at", *(c for c in table.columns if c not in ("id", "md5", "created_at")))]
    one = near.withColumn("_place", F.row_number().over(Window.partitionBy("md5").orderBy(*ties))).where("_place = 1")
    none = table.where(F.col("md5").isNull()).orderBy(F.asc_nulls_last("id"), *ties).limit(1)
    return one.select(*table.columns).unionByName(none)


def shuffle_key(seed: int) -> Column:
    """A post's place in the order that a seed shuffles posts into: a hash of the seed and the id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))


def ordered(posts: DataFrame, column: str, descending: bool, seed: int = 0) -> DataFrame:
    """Sorted with nulls first either way, ties by id; or shuffled by a seed. A seed has one order, however the
    posts are partitioned and whichever tasks run again."""
    if column == "random":
        return posts.orderBy(shuffle_key(seed), "id", F.asc_nulls_first("md5"), F.asc_nulls_first("created_at"))
    key = F.desc_nulls_first(column) if descending else F.asc_nulls_first(column)
    return posts.orderBy(key, F.asc_nulls_first("id"))


def search(posts: DataFrame, spec: SearchSpec) -> DataFrame:
    found = matching(posts, spec)
    found = first_of_file(found) if spec.dedup else found
    return ordered(found, *spec.order(), spec.seed)


def preview(result: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows with the columns that a result list shows."""
    return result.select("id", "rating", "score", "fav_count", "tag_string").limit(rows)


def post_links(posts: DataFrame, base: str) -> DataFrame:
    """(id, url): where each post can be seen."""
    return posts.select("id", F.concat(F.lit(f"{base}/posts/"), F.col("id").cast("string")).alias("url"))
