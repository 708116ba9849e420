"""Posts kept for searching: by month, clustered by tag, with an index of where each tag lies.

A store is a folder with four Parquet tables.

- ``posts``: a folder for each month, within it posts that share a work or character lie together. Beside the
  posts' columns stand ``tags`` (what is between single spaces of tag_string, as an exact term matches it),
  ``words`` (what is between any white space, as a wildcard matches it; null where it is the same) and
  ``block``, the number of a run of rows that is one Parquet row group or two.
- ``index``: (tag, month, file, block), sorted by tag, with Parquet's Bloom filters on it.
- ``words``: (word, posts), the dictionary of the store.
- ``trigrams``: (trigram, word), sorted by trigram, of words between two marks.

A search first asks the small tables. A wildcard becomes the words that have all its trigrams
and fit it; the tags of the clauses become the blocks that have one of each clause. Only the
files of these blocks are opened, and ranges of blocks reach the scan, so other row groups are
skipped; dates become months, and other folders are not even listed. The terms themselves
are tested on every row that is read, so the result is that of the same search over the posts.

What comes to the driver is bounded: at most ``most`` words for a wildcard and ``most`` blocks. A wildcard of
more words is matched as a regular expression on the posts; a search of more blocks reads all of its months.

Defined cases. Dates that don't begin with a year and a month lie in the folder "other", which every search by date
reads too; posts without a date lie in "none". A null tag_string has no tags. Posts that repeat are kept each.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import date_unit, spaced_tags, tag_array, wildcard_pattern
from tagloom.model import POSTS_SCHEMA
from tagloom.operators.search import SearchSpec, first_of_file, ordered
from tagloom.plans.query import Term, parse
from tagloom.sources.posts import conform, source_bytes

BLOCK_ROWS, MOST, RANGES = 20_000, 10_000, 64
#: Of the files that posts are read from, for each range that is written; bits of a block's number within its range.
PART_BYTES, RANGE_BITS = 8 << 20, 20
OTHER, NONE = "other", "none"
START, END = "\x02", "\x03"
CLUSTER = ("tag_string_copyright", "tag_string_character", "tag_string_artist", "id")
STORED = T.StructType([
    *POSTS_SCHEMA.fields, T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(T.StringType())),
    T.StructField("block", T.LongType()), T.StructField("month", T.StringType()),
])
#: What a scan returns beside the posts' columns.
PLACES = ("tags", "words", "block", "month")


def month_of(created_at: Column) -> Column:
    unit = date_unit(created_at, "Month")
    return F.when(created_at.isNull(), NONE).when(F.coalesce(unit.rlike(r"^\d{4}-\d\d$"), F.lit(False)), unit).otherwise(OTHER)


def between_months(date_from: str | None, date_to: str | None) -> Column:
    """Whether a folder can hold a date between two others, as strings compare."""
    if date_from is None and date_to is None:
        return F.lit(True)
    month = F.col("month")
    tests = [month != NONE]
    for bound, test in ((date_from, month.__ge__), (date_to, month.__le__)):
        if bound is not None:
            tests.append((month == OTHER) | test(bound[:7]))
    return reduce(Column.__and__, tests)


def trigrams_of(pattern: str) -> list[str]:
    """The trigrams that every word that fits a wildcard has, between the marks of its ends."""
    runs = f"{START}{pattern}{END}".split("*")
    return sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})


class PostStore:
    """A store that was written; see the module."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most
        self.index = spark.read.schema("tag string, month string, file string, block long").parquet(f"{self.path}/index")
        self.words = spark.read.schema("word string, posts long").parquet(f"{self.path}/words")
        self.trigrams = spark.read.schema("trigram string, word string").parquet(f"{self.path}/trigrams")

    @staticmethod
    def write(posts: DataFrame, path: str, *, block_rows: int = BLOCK_ROWS, parts: int | None = None, most: int = MOST) -> PostStore:
        """Store posts below a new folder. ``parts``: how many ranges of posts are written side by side, by default as
        many as shuffles have, or one for each PART_BYTES of the posts' files if those are more: a range is sorted
        in one task, and one that grows with the input would spill."""
        spark, path = posts.sparkSession, path.rstrip("/")
        parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source_bytes(posts) // PART_BYTES))
        words, tags = tag_array(F.col("tag_string")), spaced_tags(F.col("tag_string"))
        rows = conform(posts).withColumn("month", month_of(F.col("created_at")))
        placed = rows.repartitionByRange(parts, "month", *CLUSTER).sortWithinPartitions("month", *CLUSTER)
        placed = placed.withColumn("tags", tags).withColumn("words", F.when(words != tags, words))  # neither shuffled nor sorted
        number = F.monotonically_increasing_id()  # the range's number, and the row's within it
        block = F.shiftleft(F.shiftright(number, 33), RANGE_BITS) + F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)
        placed.withColumn("block", block.cast("long")).select(*STORED.fieldNames()).write.partitionBy("month").option("parquet.block.row.count.limit", block_rows).parquet(f"{path}/posts")
        stored = spark.read.schema(STORED).parquet(f"{path}/posts")
        every = F.when(F.col("words").isNull(), F.col("tags")).otherwise(F.array_union("tags", "words"))
        span = F.shiftright("block", RANGE_BITS).alias("span")
        files = stored.select("month", span, F.col("_metadata.file_name").alias("file")).distinct()  # few: names come last
        lies = stored.select(F.explode(every).alias("tag"), "month", "block").distinct().select("*", span)
        lies = lies.join(F.broadcast(files), ["month", "span"]).select("tag", "month", "file", "block")
        lies.repartitionByRange(parts, "tag").sortWithinPartitions("tag", "month", "block").write.options(**_findable("tag")).parquet(f"{path}/index")
        found = stored.select(F.explode(F.array_distinct(F.coalesce("words", "tags"))).alias("word")).groupBy("word").agg(F.count("*").alias("posts"))
        found.write.parquet(f"{path}/words")
        marked = F.concat(F.lit(START), "word", F.lit(END))
        grams = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring(marked, i, F.lit(3)))
        pairs = spark.read.schema("word string, posts long").parquet(f"{path}/words").select(F.explode(F.array_distinct(grams)).alias("trigram"), "word")
        pairs.repartitionByRange(parts, "trigram").sortWithinPartitions("trigram", "word").write.options(**_findable("trigram")).parquet(f"{path}/trigrams")
        return PostStore(spark, path, most)

    def scan(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """All posts of the months between two dates (the dates themselves aren't tested), with PLACES."""
        return self.spark.read.schema(STORED).parquet(f"{self.path}/posts").where(between_months(date_from, date_to))

    def words_like(self, pattern: str) -> list[str] | None:
        """The store's words that a wildcard fits; None for more than ``most``, and for stars alone, which fit
        posts without words too."""
        if not pattern.strip("*"):
            return None
        grams = trigrams_of(pattern)
        if grams:
            found = self.trigrams.where(F.col("trigram").isin(grams)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        else:
            found = self.words
        # a star stands for anything, and words have no white space
        likely = reduce(lambda test, run: test & F.contains("word", F.lit(run)), (r for r in pattern.split("*") if r), F.lit(True))
        rows = found.where(likely & F.col("word").rlike(_whole(pattern))).select("word").limit(self.most + 1).collect()
        return None if len(rows) > self.most else sorted(r["word"] for r in rows)

    def _tested(self, terms: Iterable[Term]) -> dict[Term, tuple[Column, list[str] | None]]:
        """For each term on tags: its test on a stored row, and the tags one of which a row must have."""
        out = {}
        for term in terms:
            if term.kind == "tag":
                own, tags = F.array_contains("tags", term.value), [term.value]
            elif term.kind == "wildcard" and (tags := self.words_like(term.name)) is not None:
                own = F.exists(F.coalesce("words", "tags"), _one_of(tags))
            else:
                continue
            out[term] = (~own, None) if term.negated else (own, tags)
        return out

    def _blocks(self, wanted: list[list[str]], months: Column) -> list[tuple[str, str, int]] | None:
        """(month, file, block) of all blocks with a tag of each list; None for more than ``most``."""
        asked = [self.index.where(F.col("tag").isin(tags) & months).select("month", "file", "block", F.lit(i).alias("clause")) for i, tags in enumerate(wanted)]
        met = reduce(DataFrame.unionByName, asked).groupBy("month", "file", "block").agg(F.count_distinct("clause").alias("n"))
        rows = met.where(F.col("n") == len(wanted)).select("month", "file", "block").limit(self.most + 1).collect()
        return None if len(rows) > self.most else sorted(map(tuple, rows))

    def matching(self, spec: SearchSpec) -> DataFrame:
        """The stored posts that a search finds, with their own columns; see the module."""
        query = parse(spec.query)
        tested = self._tested(t for clause in query.clauses for t in clause)
        wanted = [[tag for t in clause for tag in tested[t][1]] for clause in query.clauses if all(t in tested and tested[t][1] is not None for t in clause)]
        rows = self.scan(spec.date_from, spec.date_to)
        blocks = self._blocks(wanted, between_months(spec.date_from, spec.date_to)) if wanted else None
        if blocks is not None:
            folder = f"{self.path}/posts"
            files = sorted({f"{folder}/month={month}/{file}" for month, file, _ in blocks})
            if not files:
                return rows.limit(0).select(*POSTS_SCHEMA.fieldNames())
            near = self.spark.read.schema(STORED).option("basePath", folder).parquet(*files)
            rows = near.where(between_months(spec.date_from, spec.date_to) & _in_ranges("block", [b for _, _, b in blocks]))
        own = {t: column for t, (column, _) in tested.items()}
        return rows.where(reduce(Column.__and__, spec.conditions(own.get))).select(*POSTS_SCHEMA.fieldNames())

    def search(self, spec: SearchSpec) -> DataFrame:
        found = self.matching(spec)
        found = first_of_file(found) if spec.dedup else found
        return ordered(found, *spec.order(), spec.seed)

    def in_windows(self, windows: DataFrame) -> DataFrame:
        """The posts of each row of windows(name, date_from, date_to), with ``name``; a post in several comes
        once for each. Only the months that some window touches are read, found as the query runs."""
        month = lambda c: F.try_to_date(F.concat(F.substring(c, 1, 7), F.lit("-01")))
        spanned = F.transform(F.sequence(month("date_from"), month("date_to"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
        months = F.concat(F.coalesce(spanned, F.array().cast("array<string>")), F.array(F.lit(OTHER)))
        wanted = windows.where("date_from <= date_to").select("name", "date_from", "date_to", F.explode(months).alias("month"))
        posts = self.spark.read.schema(STORED).parquet(f"{self.path}/posts")
        joined = posts.join(F.broadcast(wanted), "month")
        return joined.where("created_at >= date_from and created_at <= date_to").select(*POSTS_SCHEMA.fieldNames(), "name")


def _findable(column: str) -> dict[str, str]:
    """Options of a table that is looked up by a column: small row groups with Bloom filters."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": "20000", "parquet.block.row.count.limit": "100000"}


def _whole(pattern: str) -> str:
    return rf"^{wildcard_pattern(pattern, r'\S*')}\z"


def _one_of(tags: list[str]):
    return lambda t: t.isin(tags) if tags else F.lit(False)


def _in_ranges(column: str, values: list[int], most: int = RANGES) -> Column:
    """Whether a number is one of the values, or between two of them that lie close: at most so many ranges."""
    values = sorted(set(values))
    gaps = sorted(((b - a, i) for i, (a, b) in enumerate(zip(values, values[1:], strict=False)) if b - a > 1), reverse=True)[: most - 1]
    cuts = [0, *sorted(i + 1 for _, i in gaps), len(values)]
    spans = [(values[a], values[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return reduce(Column.__or__, [F.col(column).between(low, high) for low, high in spans])
