"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every whole text and counts how often each slot of a blocked Bloom
filter is hit (two bits in one 64-bit word, one number for each text). Slots that were hit twice or
more form a second filter. Pass 2 tests every row: a text that occurs twice hits only
such slots, so a row that misses one is unique and passes straight through without a
shuffle. Only the rest ("possibly repeated") are grouped by their SHA-256.

Bounds. The broadcast filter has at most ``max_filter_bits / 64`` rows of 16 bytes; unless given, so
many that they take about a thirty-second of an executor's memory or the driver's, if that is less, and 2**20 rows at least.
Beyond about ``max_filter_bits / 16`` texts it passes less and less straight through, and
rows are grouped by digest instead; the result is the same. Groups with at least a
65,536th of all rows are at most 65,536, so their keepers are broadcast and none of their
rows meets in one task; all other rows join by digest.

Defined cases. A null text is the empty text. Null ids sort after all others: a group
with only null ids has a null keep_id. Rows that repeat both text and id count in
group_size; mark() calls each of them kept if their id is the keeper's, dedup() returns
one of them. Columns of the input that are named like a result column are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.joins import with_ids
from tagloom.llm.store import materialise, unused

HOT_SHARE = 65536
MIN_FILTER_BITS, ROW_COST, MEMORY_SHARE = 1 << 26, 64, 32


def filter_bits(spark: SparkSession) -> int:
    """The filter's bits for which this session's executors have room, and its driver, where it is put together."""
    conf = spark.sparkContext.getConf()
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    memory = min(size(conf.get(f"spark.{who}.memory", "1g")) for who in ("executor", "driver"))
    return max(MIN_FILTER_BITS, memory // MEMORY_SHARE // ROW_COST * 64)


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty. A run that is one
    space already is no match, which spares most of the work."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _bit(hashed: Column, shift: int) -> Column:
    return F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit(63))


def repeated_slots(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits): of each word of the filter, the bits of the slots that at least two rows hit. A slot is
    a word and both its bits, so one number for each row is counted."""
    h = F.xxhash64(key)
    slots = keys.select((F.pmod(h, F.lit(words)) * 4096 + _bit(h, 40) * 64 + _bit(h, 46)).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count("*").alias("hits")).where("hits >= 2")
    both = F.expr("shiftleft(1L, cast(shiftright(slot, 6) & 63 as int)) | shiftleft(1L, cast(slot & 63 as int))")
    return twice.groupBy(F.expr("shiftright(slot, 12)").alias("word")).agg(F.bit_or(both).alias("bits"))


class _Filter:
    """Tells which digests possibly repeat, by the second of the two filters."""

    def __init__(self, keys: DataFrame, digest: str, max_filter_bits: int | None):
        self.rows = keys.count()
        self.words = max(64, min(max_filter_bits or filter_bits(keys.sparkSession), 1 << (max(1, self.rows) * 16 - 1).bit_length()) // 64)
        self.digest, self.twice = digest, repeated_slots(keys, digest, self.words)

    def test(self, df: DataFrame) -> tuple[DataFrame, str]:
        """df with a column that is false where the digest is certainly alone."""
        word, bits, flag = unused(df, "word", "bits", "maybe")
        hashed = F.xxhash64(self.digest)
        wanted = reduce(Column.bitwiseOR, (F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({self.digest}), {s}) & 63 as int))") for s in (40, 46)))
        met = df.withColumn(word, F.pmod(hashed, F.lit(self.words))).join(F.broadcast(self.twice.toDF(word, bits)), word, "left")
        return met.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(wanted) == wanted, F.lit(False))).drop(word, bits), flag


def mark_digests(df: DataFrame, digest: str, *, id_col: str = "doc_id", keep: str = "min", max_filter_bits: int | None = None, keys: DataFrame | None = None, filter_: _Filter | None = None) -> DataFrame:
    """df with keep_id, group_size and kept, for rows whose column ``digest`` is computed.

    keys: a narrow, materialised table of the same rows' id and digest, if df is wide, or of more
    rows that the groups are made of. keep: "min" or "max", which id of a group stays.
    """
    best = {"min": F.min, "max": F.max}[keep]
    keys = df if keys is None else keys
    seen = filter_ or _Filter(keys, digest, max_filter_bits)
    own, = unused(df, "own_digest")
    asked, flag = seen.test(keys)
    groups = asked.where(flag).groupBy(F.col(digest).alias(own)).agg(best(id_col).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    hot_rows = max(64, -(-seen.rows // HOT_SHARE))
    hot = F.broadcast(groups.where(F.col("group_size") >= hot_rows))
    cold = groups.where(F.col("group_size") < hot_rows)
    result = ("keep_id", "group_size", "kept")
    tested, flag = seen.test(df.drop(*(c for c in df.columns if c.lower() in result)))
    at_hot = tested.join(hot, F.col(digest) == F.col(own), "left").drop(own)
    straight = at_hot.where(~F.col(flag) | F.col("group_size").isNotNull())
    dealt = at_hot.where(F.col(flag) & F.col("group_size").isNull()).drop("keep_id", "group_size").join(cold, F.col(digest) == F.col(own), "left").drop(own)
    both = straight.unionByName(dealt).drop(flag)
    alone = F.col("group_size").isNull()
    both = both.withColumn("keep_id", F.when(alone, F.col(id_col)).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint")))
    return both.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def mark(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row: one scan of the texts."""
    keys = materialise(df.select(F.col(id_col), text_digest(F.col(text_col)).alias("text_sha256")), "digests")
    return mark_digests(keys, "text_sha256", id_col=id_col, **options)


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int | None = None, **options) -> DataFrame:
    """The rows of df that stay, with df's columns. One scan of the texts for their digests; rows
    whose id no possibly repeated text has pass straight in a second one, and a third writes the
    others, which alone are hashed again and shuffled."""
    digest, = unused(df, "text_sha256")
    clash = [c for c in df.columns if c.lower() in ("keep_id", "group_size", "kept")]
    aside = unused(df, *(f"own_{c}" for c in clash))
    renamed = df.withColumnsRenamed(dict(zip(clash, aside, strict=True)))
    new = dict(zip(clash, aside, strict=True))
    own_id, own_text = new.get(id_col, id_col), new.get(text_col, text_col)
    keys = materialise(renamed.select(own_id, text_digest(F.col(own_text)).alias(digest)), "digests")
    filter_ = _Filter(keys, digest, max_filter_bits)
    asked, flag = filter_.test(keys)
    seen, maybe = with_ids(renamed, asked.where(flag).select(own_id), own_id)
    again = F.col(maybe) | F.col(own_id).isNull()
    repeated = materialise(seen.where(again).drop(maybe).withColumn(digest, text_digest(F.col(own_text))), "repeated")
    kept = mark_digests(repeated, digest, id_col=own_id, keys=keys, filter_=filter_, **options).where("kept")
    once = kept.where("group_size = 1").unionByName(kept.where("group_size > 1").dropDuplicates([own_id, digest]))
    every = seen.where(~again).drop(maybe).unionByName(once.drop("keep_id", "group_size", "kept", digest))
    return every.withColumnsRenamed(dict(zip(aside, clash, strict=True))).select(*df.columns)
