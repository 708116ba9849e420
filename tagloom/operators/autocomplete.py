"""Completing the word before the cursor from the tag dictionary."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions.text import human_count


def word_before(text: str, cursor: int) -> str:
    """The word that ends at the cursor, in lower case, without a leading - or ~."""
    word = re.split(r"\s+", text[:cursor])[-1]
    return word.removeprefix(word[:1] if word[:1] in ("-", "~") else "\0").lower()


def complete(entries: DataFrame, word: str, n: int = 20) -> DataFrame:
    """(display, tag, color, count, shown_count) of the n most frequent entries whose key starts
    with the word, or has it after an underscore. Words of one letter have none."""
    found = entries.where(F.startswith("key", F.lit(word)) | F.contains("key", F.lit("_" + word))) if len(word) >= 2 else entries.limit(0)
    return _shown(found.orderBy(F.desc("count"), "display", "key", "color").limit(n))


def _shown(first: DataFrame) -> DataFrame:
    return first.select("display", "tag", "color", "count", human_count(F.col("count")).alias("shown_count"))


def by_prefix(entries: DataFrame, longest: int = 6, n: int = 20) -> DataFrame:
    """(prefix, place, display, tag, color, count): for every beginning of two to ``longest`` letters of a key, or of
    what follows an underscore in one, its n most frequent entries. Each task keeps its own n first,
    so a prefix that very many keys have is no hot key."""
    size = F.char_length("key")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (i == 1) | (F.substring("key", i - 1, F.lit(1)) == "_"))
    lengths = F.array(*map(F.lit, range(2, longest + 1)))
    cuts = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(lengths, lambda k: i + k - 1 <= size), lambda k: F.substring("key", i, k))))
    pairs = entries.where(size >= 2).select(F.explode(F.array_distinct(cuts)).alias("prefix"), *entries.columns)
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("count"), "display", "key", "color"))
    return pairs.withColumn("place", place).where(F.col("place") <= n).select("prefix", "place", "display", "tag", "color", "count")


class Completions:
    """Completions kept in files: a row for each prefix, found by the row group it lies in. Words that are
    longer than the longest prefix are looked for among the entries, as complete() does."""

    SCHEMA = "prefix string, best array<struct<place: int, display: string, tag: string, color: string, count: bigint>>"

    def __init__(self, spark: SparkSession, path: str, longest: int = 6):
        self.longest = longest
        self.prefixes = spark.read.schema(self.SCHEMA).parquet(f"{path}/prefixes")
        self.entries = spark.read.schema("key string, display string, tag string, color string, count long").parquet(f"{path}/entries")

    @staticmethod
    def write(entries: DataFrame, path: str, longest: int = 6, n: int = 20, parts: int | None = None) -> Completions:
        spark = entries.sparkSession
        entries.select("key", "display", "tag", "color", "count").write.parquet(f"{path}/entries")
        kept = spark.read.schema("key string, display string, tag string, color string, count long").parquet(f"{path}/entries")
        best = by_prefix(kept, longest, n).groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("place", "display", "tag", "color", "count"))).alias("best"))  # n each at most
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = best.repartitionByRange(parts, "prefix").sortWithinPartitions("prefix")
        placed.write.option("parquet.bloom.filter.enabled#prefix", "true").option("parquet.block.row.count.limit", 10_000).parquet(f"{path}/prefixes")
        return Completions(spark, path, longest)

    def complete(self, word: str) -> DataFrame:
        """The same rows as complete() of the entries, in the same order."""
        if not 2 <= len(word) <= self.longest:
            return complete(self.entries, word)
        return _shown(self.prefixes.where(F.col("prefix") == word).select(F.inline("best")).orderBy("place"))
