"""What must not grow with the input: lines grouped in front of a shuffle, ranges and buckets of one task, reads of one query."""

import pytest
from pyspark.sql import functions as F

from tagloom import queries
from tagloom.operators import explosion, search, seasonality, tags
from tagloom.sources import posts as sources
from tagloom.sources import stored, upkeep
from tagloom.testing.posts_view import posts

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Posts in one file."""
    path = str(tmp_path_factory.mktemp("few") / "p")
    posts(spark, DATA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_lines_are_dealt_before_they_are_grouped(spark):
    plan = plan_of(posts(spark, DATA)).splitlines()
    partial = next(i for i, line in enumerate(plan) if "partial_collect_set" in line)
    assert "Exchange hashpartitioning(k#" in plan[partial + 1]


def test_tags_of_a_post_are_told_apart_without_lists_in_lists(few):
    """A tag of several categories has the first of them; no list of all tags is cut for each tag."""
    changed = few.withColumn("tag_string_general", F.concat_ws(" ", "tag_string_general", "tag_string_artist"))
    found = explosion.count(changed, queries.ALL).tags
    assert "array_min" not in plan_of(found)
    assert {r["category"] for r in found.collect() if r["tag"].startswith("supplier_")} == {"artist"}


def test_ranges_of_a_store_follow_the_files(few, tmp_path, monkeypatch):
    assert sources.source_bytes(few) > 0
    monkeypatch.setattr(stored, "PART_BYTES", sources.source_bytes(few) // 20 + 1)
    store = stored.PostStore.write(few, str(tmp_path / "s"), block_rows=8)
    blocks = store.scan().select(F.shiftright("block", stored.RANGE_BITS).alias("r")).distinct().count()
    assert blocks > int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = store.scan().select("month", F.col("_metadata.file_name").alias("file"), "block").distinct()
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, store.index.select("month", "file", "block").distinct().collect()))


def test_buckets_follow_the_files(spark, few, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BUCKET_BYTES", sources.source_bytes(few) // 30 + 1)
    table = search.write_by_file(few, "posts_by_file_growth", str(tmp_path / "t"), 4)
    places = table.select("md5", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.", 1).alias("bucket"), F.col("_metadata.file_name").alias("file"))
    assert places.where("md5 is not null").select("bucket").distinct().count() > 20
    assert places.where("md5 is not null").groupBy("bucket").agg(F.count_distinct("file").alias("n")).agg(F.max("n")).first()[0] == 1
    assert places.where("md5 is null").select("file").distinct().count() > 1
    assert sorted(r["id"] for r in search.first_of_bucketed(table).collect()) == sorted(r["id"] for r in search.first_of_file(few).collect())


def runs_over_lines(spark):
    """How many of the queries that ran so far read the lines that posts are made of."""
    every = spark._jsparkSession.sharedState().statusStore().executionsList()
    return sum("lineitem.parquet" in every.apply(i).physicalPlanDescription() for i in range(every.size()))


@pytest.mark.parametrize("name", ["sort_orders", "tag_map_exact_top", "seasonality_kept", "kept_counts", "kept_totals", "kept_months"])
def test_posts_are_made_once(spark, name):
    """What several passes need is read from files that were written in one."""
    before = runs_over_lines(spark)
    plan = plan_of(queries.QUERIES[name](spark, DATA))
    assert runs_over_lines(spark) == before + 1 and "lineitem.parquet" not in plan


@pytest.mark.parametrize("name", ["bubble_edges", "bubble_degree", "bubble_weights", "bubble_stronger", "bubble_named"])
def test_a_graph_makes_its_posts_once(spark, name):
    """Nodes and pairs are two passes over tags that were written in one."""
    before = runs_over_lines(spark)
    plan = plan_of(queries.QUERIES[name](spark, DATA))
    assert runs_over_lines(spark) == before + 1 and "lineitem.parquet" not in plan
    assert plan.count("FileScan parquet") <= 1


def test_occurrences_of_tags_are_not_sorted(few):
    """Only the counts are, of which each tag has one for each category and task."""
    plan = plan_of(tags.all_tags(few))
    assert "SortAggregate" not in plan.rpartition("Exchange hashpartitioning(tag")[2]
    double = few.select("id", "md5", F.lit("x y").alias("tag_string_artist"), F.lit("y").alias("tag_string_meta"))
    found = {r["tag"]: (r["category"], r["count"]) for r in tags.all_tags(double).collect()}
    assert found == {"x": ("artist", few.count()), "y": ("mixed", 2 * few.count())}


@pytest.mark.parametrize("name", ["seasonality_peaks", "seasonality_heat", "seasonality_heat_levels", "seasonality_on_day"])
def test_peaks_are_found_once(spark, name):
    """The posts are read once, and a sort samples peaks that were dealt, not the search for them."""
    plan = plan_of(queries.QUERIES[name](spark, DATA))
    assert plan.count("lineitem.parquet") == 1
    if "Exchange rangepartitioning(score" in plan:
        dealt = plan[plan.index("Exchange rangepartitioning(score") :]
        assert dealt.index("REPARTITION_BY_COL") < dealt.index("Generate")


def test_windows_without_looking_up_each_day(spark):
    rows = [("a", d, n) for d, n in ((0, 3), (5, 1), (364, 2), (365, 4))] + [("b", 100, 7)]
    counted = spark.createDataFrame(rows, "tag string, doy int, n long")
    found = seasonality.ahead(counted, 7)
    assert "map_keys" not in plan_of(found)
    want = {(t, d): sum(n for tag, doy, n in rows if tag == t and (doy - d) % 366 < 7) for t in "ab" for d in range(366)}
    assert {(r["tag"], r["doy"]): r["total"] for r in found.collect()} == want


def test_counts_in_one_aggregate(few):
    tags, every = seasonality.parts_of(seasonality.counted(few))
    one, other = seasonality.from_each(tags, every, 5), seasonality.count(few, 5)
    for name in ("days", "months", "all_months", "categories"):
        assert sorted(map(tuple, getattr(one, name).collect())) == sorted(map(tuple, getattr(other, name).collect()))


def test_an_arrival_leaves_three_tables(spark, few, tmp_path):
    store = upkeep.CountStore(spark, str(tmp_path / "u"))
    store.add(few)
    (made,) = store.kept.current()["generations"]
    assert sorted(p.name for p in (tmp_path / "u" / made).iterdir()) == ["months", "seen", "tags"]
