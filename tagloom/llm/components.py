"""Connected components of a table of links, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, comp): comp is the smallest node that can be reached.

    Every round takes the smallest label among a node's neighbours and then the label of
    that label, so the number of rounds grows with the logarithm of a component's width.
    Each round is a written table; a node with very many links is summed up before the
    shuffle, and joins to it are split by adaptive execution.
    """
    both = materialise(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")).withColumn("changed", F.lit(True)), "labels")
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.select("node", "comp").join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("high"))
        jumped = step.join(up, "low", "left").select("node", F.least("low", F.coalesce("high", "low")).alias("to"), "comp")
        after = materialise(jumped.select("node", F.col("to").alias("comp"), (F.col("to") < F.col("comp")).alias("changed")), "labels")
        discard(labels)
        labels = after
    discard(both)
    return labels.select("node", "comp")
