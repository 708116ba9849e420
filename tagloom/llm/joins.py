"""Joins that keep wide rows where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.store import unused

FILTER_WORDS = 1 << 20
HOT_SHARE, HOT_SIZE = 65536, 1 << 20


def look_up(rows: DataFrame, table: DataFrame, key: str, count: int, size: str = "1") -> DataFrame:
    """rows left-joined to table, whose column key is unique. Keys with at least a 65,536th
    of the count rows are at most 65,536; of these, the most frequent are broadcast until their
    sizes (an expression over table) add up to HOT_SIZE. The rest join by shuffle."""
    hot = max(64, -(-count // HOT_SHARE))
    mark, = unused(rows.join(table.limit(0), key, "left"), "at_hot")
    often = rows.groupBy(key).agg(F.count("*").alias(mark)).where(F.col(mark) >= hot).join(table, key)
    summed, = unused(often, "sum_of_sizes")
    before = Window.orderBy(F.desc(mark), key)  # over at most 65,536 rows
    keys = F.broadcast(often.withColumn(summed, F.sum(F.expr(size)).over(before)).where(F.col(summed) <= HOT_SIZE).drop(summed))
    first = rows.join(keys, key, "left")
    done = first.where(F.col(mark).isNotNull()).drop(mark)
    rest = first.where(F.col(mark).isNull()).select(*rows.columns).join(table, key, "left")
    return done.unionByName(rest)


def _bit(column: str, shift: int) -> str:
    return f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(cast(`{column}` as bigint)), {shift}) & 63 as int))"


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df with a column that is false where the key is certainly not in ids, and for a null key."""
    return _tested(df, key, ids)


def _tested(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, str]:
    """df with a column that is false where the key is certainly not in ids (one column, no
    nulls). The Bloom filter that is broadcast has at most 2**20 rows of 16 bytes."""
    word, bits, maybe, other = unused(df, "word", "bits", "maybe", "other")
    place = f"pmod(xxhash64(cast(`{{}}` as bigint)), {FILTER_WORDS})"
    both = f"{_bit('{0}', 40)} | {_bit('{0}', 46)}"
    ids = ids.toDF(other)
    table = ids.select(F.expr(place.format(other)).alias(word), F.expr(both.format(other)).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    seen = df.withColumn(word, F.expr(place.format(key))).join(F.broadcast(table), word, "left")
    hit = F.expr(f"`{bits}` & ({both.format(key)})") == F.expr(both.format(key))
    return seen.withColumn(maybe, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop(word, bits), maybe


def without_ids(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id is not in gone (one column of ids, materialised). Rows without
    an id stay. Rows that a Bloom filter excludes are not shuffled; the others are tested exactly."""
    own, = unused(df, "gone_id")
    ids = gone.toDF(own).where(F.col(own).isNotNull()).distinct()
    seen, maybe = _tested(df, id_col, ids)
    kept, asked = seen.where(~F.col(maybe)).drop(maybe), seen.where(maybe).drop(maybe)
    return kept.unionByName(asked.join(ids, F.col(id_col) == F.col(own), "left_anti")).select(*df.columns)
