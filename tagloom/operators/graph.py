"""The graph of tags that occur together.

Nodes are few (``max_nodes``, at most some hundreds), so their names and counts are one map, a scalar
subquery; the pairs of each post are made of its nodes alone, within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import tag_array
from tagloom.model import CATEGORIES, MIXED, column_of
from tagloom.operators.tags import all_tags, has_focus, labelled_tags, ranked

ALL = (*CATEGORIES, "mixed", "unknown")
MOST_NODES = 1000


def _beside(posts: DataFrame, focus: str) -> DataFrame:
    """(tag, count, coverage, category, related, beside): every tag with its category among all posts, and with its
    count and category among those that have the focus; one count of all tags for both."""
    near = posts.select(F.when(has_focus(posts, focus), True).otherwise(False).alias("near"), F.explode(labelled_tags(posts)).alias("p"))
    only = lambda c: F.when(F.col("near"), c)
    found = near.groupBy(F.col("p.tag").alias("tag")).agg(
        F.count("*").alias("count"), F.min("p.category").alias("low"), F.max("p.category").alias("high"),
        F.count_if("near").alias("related"), F.min(only(F.col("p.category"))).alias("near_low"), F.max(only(F.col("p.category"))).alias("near_high"),
    )
    # These always hold; they keep every use of the counts on the same columns, so that one exchange serves all.
    found = found.where((F.col("count") >= F.col("related")) & (F.col("low") <= F.col("high")) & (F.col("near_low").isNull() | (F.col("near_low") <= F.col("near_high"))))
    kind = lambda low, high: F.when(F.col(low) == F.col(high), F.col(low)).otherwise(MIXED)
    coverage = F.col("count") / F.greatest(F.lit(1), posts.agg(F.count("*")).scalar()) * 100.0
    return found.select("tag", "count", coverage.alias("coverage"), kind("low", "high").alias("category"), "related", kind("near_low", "near_high").alias("beside"))


def nodes(posts: DataFrame, max_nodes: int = 60, focus: str = "", categories: tuple[str, ...] = ALL) -> DataFrame:
    """(tag, category, count, coverage, related): the most frequent tags of the categories;
    with a focus, it and the tags most frequent beside it, with the counts of all posts and,
    as related, of the posts that have the focus."""
    if not 1 <= max_nodes <= MOST_NODES:
        raise ValueError(f"a graph has 1 to {MOST_NODES} nodes")
    allowed = list(categories)
    if not focus:
        every = ranked(all_tags(posts), max(8000, max_nodes * 40)).where(F.col("category").isin(allowed))
        return every.orderBy(F.desc("count"), "tag").limit(max_nodes).withColumn("related", F.lit(0).cast("long"))
    counted = _beside(posts, focus)
    every = ranked(counted, max(8000, max_nodes * 40)).where(F.col("category").isin(allowed))
    near = counted.where("related > 0").orderBy(F.desc("related"), "tag").limit(max(5000, max_nodes * 20)).where(F.col("beside").isin(allowed))
    own = every.where(F.col("tag") == focus).drop("related", "beside").join(near.select("tag", "related"), "tag", "left")
    own = own.select("tag", "category", "count", "coverage", F.coalesce("related", F.lit(0).cast("long")).alias("related"), F.lit(0).alias("turn"))
    others = near.where(F.col("tag") != focus).select("tag", "related").orderBy(F.desc("related"), "tag").limit(max_nodes)
    beside = others.join(every.drop("related", "beside"), "tag").select("tag", "category", "count", "coverage", "related", F.lit(1).alias("turn"))
    return own.unionByName(beside).orderBy("turn", F.desc("related"), "tag").limit(max_nodes).drop("turn")


def settled(chosen: DataFrame) -> DataFrame:
    """The nodes (at most MOST_NODES rows) as a local table, for several actions on them; this runs a job."""
    return chosen.sparkSession.createDataFrame(chosen.limit(MOST_NODES).collect(), chosen.schema)


def _sizes(chosen: DataFrame) -> Column:
    """The nodes' counts by tag, a bounded map that is evaluated once in a query, however often it is used."""
    return F.map_from_entries(chosen.agg(F.collect_list(F.struct("tag", "count"))).scalar())


def edge_counts(posts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(a, b, count): posts that have both nodes a < b, each post once."""
    if "tag_string" in posts.columns:
        own = tag_array(F.col("tag_string"))
    else:
        own = F.flatten(F.array(*(tag_array(F.col(column_of(c))) for c in CATEGORIES if column_of(c) in posts.columns)))
    # a generator, since uses of its column don't compute the array again
    rows = posts.select(F.explode(F.array(F.sort_array(F.array_intersect(own, F.map_keys(_sizes(chosen)))))).alias("t")).where(F.size("t") >= 2)
    first = rows.select(F.posexplode("t").alias("i", "a"), "t")
    pairs = first.select("a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("count"))


def edges(counts: DataFrame, chosen: DataFrame, min_count: int = 2, max_nodes: int = 60) -> DataFrame:
    """(a, b, count, strength): the heaviest edges; strength is the count over that of the rarer node."""
    sizes = _sizes(chosen)
    rarer = F.greatest(F.lit(1), F.least(F.try_element_at(sizes, F.col("a")), F.try_element_at(sizes, F.col("b"))))
    strong = counts.where(F.col("count") >= min_count).withColumn("strength", F.col("count") / rarer).where("strength is not null")
    return strong.orderBy(F.desc("count"), F.desc("strength"), "a", "b").limit(max(max_nodes * 5, 80))


def degrees(counts: DataFrame, chosen: DataFrame, min_count: int = 2) -> DataFrame:
    """(tag, degree): edges of each node with the least count, before the cut to the heaviest."""
    strong = counts.where(F.col("count") >= min_count)
    ends = strong.select(F.explode(F.array("a", "b")).alias("tag")).groupBy("tag").agg(F.count("*").alias("degree"))
    return chosen.select("tag").join(ends, "tag", "left").select("tag", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def radii(chosen: DataFrame) -> DataFrame:
    """chosen with ``radius``: the square root of the count, scaled to a range that narrows with
    the number of nodes."""
    n = chosen.agg(F.count("*")).scalar()
    low = F.when(n <= 40, 18.0).when(n <= 120, 14.0).otherwise(10.0)
    high = F.when(n <= 40, 56.0).when(n <= 120, 44.0).otherwise(34.0)
    root = lambda f: F.sqrt(chosen.agg(f("count")).scalar().cast("double"))
    least, most = root(F.min), root(F.max)
    scaled = (F.sqrt(F.col("count").cast("double")) - least) / F.greatest(F.lit(0.0001), most - least)
    return chosen.withColumn("radius", F.when(most <= least, (low + high) / 2.0).otherwise(low + scaled * (high - low)))


def labelled(sized: DataFrame, focus: str = "") -> DataFrame:
    """The nodes whose label is shown: the focus, the first by related and count (a fifth, 10
    to 25), and the large ones."""
    n = sized.agg(F.count("*")).scalar()
    place = F.row_number().over(Window.orderBy(F.desc("related"), F.desc("count"), "tag"))
    shown = F.least(F.lit(25), F.greatest(F.lit(10), F.floor(n / 5)))
    return sized.withColumn("place", place).where((F.col("tag") == focus) | (F.col("place") <= shown) | (F.col("radius") >= 24.0)).drop("place")


def edge_weights(drawn: DataFrame) -> DataFrame:
    """drawn with ``weight``, 0 to 1: 0.55 of the scaled count and 0.45 of the strength."""
    every = Window.partitionBy()  # a graph's few edges; two subqueries would count them twice more
    low, high = F.min("count").over(every), F.max("count").over(every)
    scaled = F.when(high > low, (F.col("count") - low) / F.greatest(F.lit(1.0), (high - low).cast("double"))).otherwise(1.0)
    mixed = scaled * 0.55 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), "strength")) * 0.45
    return drawn.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)))


def stronger(drawn: DataFrame, percent: float) -> DataFrame:
    return drawn.where(F.col("strength") >= percent / 100.0)


def named(chosen: DataFrame, drawn: DataFrame, text: str) -> DataFrame:
    """The nodes whose name contains a text, and their neighbours."""
    hits = chosen.where(F.contains(F.lower("tag"), F.lit(text.lower()))).select("tag")
    way = lambda x, y: F.struct(F.col(x).alias("tag"), F.col(y).alias("other"))
    both = drawn.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    near = both.join(F.broadcast(hits), "tag", "left_semi").select(F.col("other").alias("tag"))
    return chosen.join(F.broadcast(hits.unionByName(near).distinct()), "tag", "left_semi")
