"""URL filters: a blocked Bloom filter of listed rules in front of an exact hash join.

A rule is a host and the beginning of a path, "example.com/en/". It fits a URL on its host or
any subdomain whose path starts with the rule's; of those that fit, the longest wins (by its
characters, then by the labels of its host). What no rule fits gets the default verdict.

A URL's candidates are the ends of its host and the beginnings of its path whose shapes (labels
of the host, characters of the path) some rule has, so a long URL has no more candidates than
the list has shapes. Their 64-bit hashes are tested against a Bloom filter whose blocks of eight
32-bit words have one bit in each, in numpy over whole Arrow batches. Candidates that pass are
possible hits and are joined to the list by their text, which removes false positives; rows
without any go straight through.

Bounds. The filter that is broadcast has at most ``max_blocks`` blocks of 32 bytes, and 16 bits for
each rule below that; beyond it more candidates pass to the join, with the same result. The
shapes come to the driver: at most the labels of a host times the characters of a rule. Rules
that a 65,536th of the possible hits ask for are broadcast, at most 2**20; the rest join by shuffle.

Defined cases. The host is what stands after the first "://" up to "/", "?", "#" or the end, with A-Z in lower
case; the path goes on from there up to "?", "#" or the end. A null URL, or one without "://", has
an empty host and path. A rule listed with both verdicts blocks; rules that are null, without a host or with
another verdict than allow or block are left out. An empty list leaves every row its default.
Rows that repeat are judged each. Columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.joins import look_up
from tagloom.llm.store import materialise, small_batches, tidy, unused

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULE = r"(?s)^([^/]*)(.*)$"
MAX_BLOCKS, KEYS_PER_BLOCK, WORDS = 1 << 20, 16, 8
VERDICTS = ("allow", "block")


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 2)


def rules(spark: SparkSession, listed: Iterable[tuple[str, str]]) -> DataFrame:
    """A table of rules from (verdict, "host/path") pairs."""
    return spark.createDataFrame(list(listed), "verdict string, rule string")


def _listed(table: DataFrame) -> DataFrame:
    """(key, labels, length, rank): one row for each rule; the greatest rank wins."""
    host, path = _lower(F.regexp_extract("rule", RULE, 1)), F.regexp_extract("rule", RULE, 2)
    cut = table.where(F.col("verdict").isin(*VERDICTS)).select(host.alias("host"), path.alias("path"), "verdict").where("host <> ''")
    key = cut.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("length"), (F.col("verdict") == "block").cast("int").alias("block"))
    rank = F.expr("shiftleft(cast(char_length(key) as bigint), 32) + shiftleft(cast(labels as bigint), 1) + block")
    return key.groupBy("key", "labels", "length").agg(F.max("block").alias("block")).withColumn("rank", rank).drop("block")


def _end_of(host: Column, labels: int | Column) -> Column:
    cut = F.split(host, r"\.")
    return F.array_join(F.slice(cut, F.size(cut) - labels + 1, F.lit(labels) if isinstance(labels, int) else labels), ".")


def _after(end: Column) -> Callable[[Column], Column]:
    return lambda start: F.concat(end, start)


def _candidates(host: Column, path: Column, shapes: dict[int, list[int]]) -> Column:
    """The rules that would fit, of the shapes that some rule has."""
    none = F.array().cast("array<string>")
    found = []
    for labels, lengths in sorted(shapes.items()):
        fit = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length(path))
        made = F.transform(F.transform(fit, lambda n: F.substring(path, F.lit(1), n)), _after(_end_of(host, labels)))
        found.append(F.when((F.size(F.split(host, r"\.")) >= labels) & (host != ""), made).otherwise(none))
    return F.flatten(F.array(*found)) if found else none


class BlockedBloom:
    """words[block, 8]: a key has one bit in each word of its block, all taken from its 64-bit hash."""

    def __init__(self, keys: DataFrame, key: str, count: int, max_blocks: int = MAX_BLOCKS):
        self.blocks = 1 << min(max(6, (count // KEYS_PER_BLOCK).bit_length()), max_blocks.bit_length() - 1)
        hashed = keys.select(F.xxhash64(key).alias("h"))
        bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {24 + 5 * i}) & 31 as int))").alias(f"w{i}") for i in range(WORDS)]
        summed = hashed.select(F.col("h").bitwiseAND(F.lit(self.blocks - 1)).alias("block"), *bits).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
        self.words = np.zeros((self.blocks, WORDS), np.uint32)
        rows = summed.toArrow()  # one row for each block at most
        for i in range(WORDS):
            self.words[rows["block"].to_numpy(), i] = rows[f"w{i}"].to_numpy().astype(np.uint32)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        block = (h & np.uint64(self.blocks - 1)).astype(np.int64)
        held = np.ones(len(h), bool)
        for i in range(WORDS):
            bit = (h >> np.uint64(24 + 5 * i) & np.uint64(31)).astype(np.uint32)
            held &= (self.words[block, i] >> bit & np.uint32(1)).astype(bool)
        return held


def _possible(df: DataFrame, bloom: BlockedBloom, keys: str, hashes: str) -> DataFrame:
    """df without the hashes, and with the candidates that the filter passes."""
    held = df.sparkSession.sparkContext.broadcast(bloom)
    out = df.drop(hashes)
    at, kept, names = df.columns.index(hashes), out.columns.index(keys), out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            offsets = lists.offsets.to_numpy()
            passed = held.value.may_hold(lists.values.to_numpy()[offsets[0] : offsets[-1]])
            before = np.concatenate(([0], np.cumsum(passed)))
            texts = batch.column(at - 1)
            first = texts.offsets.to_numpy()[0]
            chosen = texts.values.slice(first, len(passed)).filter(pa.array(passed))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns[kept] = pa.ListArray.from_arrays(pa.array(before[offsets - offsets[0]], pa.int32()), chosen)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(tidy(run), out.schema)


def judge(df: DataFrame, table: DataFrame, *, url_col: str = "url", default: str = "allow", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """df with host, path, rule and verdict; table has rule and verdict. Columns that are not
    needed are best left out before: the rows are written once, and once more shuffled if they have a possible hit."""
    small_batches(df.sparkSession, 4096)
    listed = materialise(_listed(table), "rules")
    shapes: dict[int, list[int]] = {}
    for r in listed.select("labels", "length").distinct().orderBy("labels", "length").collect():
        shapes.setdefault(r["labels"], []).append(r["length"])
    bloom = BlockedBloom(listed, "key", listed.count(), max_blocks)
    own = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url, host, path, keys, hashes, row, best = unused(df, "own_url", "own_host", "own_path", "own_keys", "own_hashes", "own_row", "own_rank")
    parsed = df.select(*own, F.col(url_col).alias(url)).withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url))).drop(url)
    asked = parsed.withColumn(keys, _candidates(F.col(host), F.col(path), shapes)).withColumn(hashes, F.transform(keys, lambda k: F.xxhash64(k)))
    seen = materialise(_possible(asked, bloom, keys, hashes).withColumn(row, F.monotonically_increasing_id()), "judged")

    named = (F.col(host).alias("host"), F.col(path).alias("path"))
    nothing = (F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    straight = seen.where(F.size(keys) == 0).select(*own, *named, *nothing)
    hits = seen.where(F.size(keys) > 0)
    possible = hits.select(row, F.explode(keys).alias("key"))
    count = hits.agg(F.sum(F.size(keys))).first()[0] or 0
    exact = look_up(possible, listed.select("key", "rank"), "key", count).where("rank is not null").groupBy(row).agg(F.max("rank").alias(best))
    met = hits.join(exact, row, "left")
    end = _end_of(F.col(host), F.expr(f"cast(shiftright(`{best}` & 4294967295, 1) as int)"))
    begun = F.substring(F.col(path), F.lit(1), F.expr(f"cast(shiftright(`{best}`, 32) as int)") - F.char_length(end))
    rule = F.when(F.col(best).isNotNull(), F.concat(end, begun)).alias("rule")
    verdict = F.when(F.col(best).isNull(), default).when(F.col(best).bitwiseAND(F.lit(1)) == 1, "block").otherwise("allow").alias("verdict")
    return straight.unionByName(met.select(*own, *named, rule, verdict))
