"""Posts kept for searching, tables kept in generations, counts kept up, dedup in buckets and on streams."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.model import CATEGORIES, POSTS_SCHEMA
from tagloom.operators import autocomplete, explosion, graph, search, seasonality, tags
from tagloom.operators.search import SearchSpec
from tagloom.plans.query import parse_term
from tagloom.sources import sinks, stored, upkeep
from tagloom.sources.generations import Conflict, Generations, source_key
from tagloom.sources.posts import conform, with_aliases
from tagloom.streaming import distinct

ROWS = 4000


def many_posts(spark, n=ROWS, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        work, name = f"work_{k * 7 // n}", f"hero_{k * 60 // n}"
        general = " ".join(rng.sample(["red_hat", "red_rod", "old_rod", "hat", "r", "a.b", "x*y", "sky", "1girl"], 3))
        spaces = {3: f"{work}\t{name} {general}", 4: f"  {general}  {work}\n", 5: None, 6: "", 7: f"{general}\x0bred_tab"}.get(k % 40, f"{work} {name} {general}")
        date = {1: None, 2: "", 9: "2024", 12: "soon", 15: "2024-13-77"}.get(k % 50, f"20{20 + k % 5}-{1 + k % 12:02d}-{1 + k % 28:02d}{'T10:00' if k % 3 else ''}")
        rows.append((k, "gsqe"[k % 4], k % 400 - 50, k % 11, work, name, general, date, f"m{k % 900}" if k % 30 else None, spaces))
    df = spark.createDataFrame(rows, "id long, rating string, score long, fav_count long, tag_string_copyright string, tag_string_character string, tag_string_general string, created_at string, md5 string, tag_string string")
    return conform(df)


@pytest.fixture(scope="module")
def posts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("posts"))
    many_posts(spark).write.mode("overwrite").parquet(path)
    return spark.read.schema(POSTS_SCHEMA).parquet(path)


@pytest.fixture(scope="module")
def store(posts, tmp_path_factory):
    return stored.PostStore.write(posts, str(tmp_path_factory.mktemp("store")), block_rows=8, parts=3)


def plan_of(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scans(df):
    """Rows and files of every scan of a query that ran, also in subqueries; what another exchange stands in for isn't read."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage")):
            return walk(node.plan())
        if name.startswith("Reused"):
            return None
        if name.startswith("Scan parquet"):
            found.append({m: node.metrics().apply(m).value() for m in ("numOutputRows", "numFiles")})
        for more in (node.children(), node.subqueries()):
            for i in range(more.size()):
                child = more.apply(i)
                walk(child.child() if child.nodeName().startswith("Subquery") else child)

    rows = df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return rows, found


def scanned(df):
    """Rows that the scans of a query that ran gave, and the files they opened."""
    rows, found = scans(df)
    return rows, {m: sum(x[m] for x in found) for m in ("numOutputRows", "numFiles")}


QUERIES = [
    "hero_17", "hero_17 red_rod", "hero_17 OR hero_3 sky", "-hero_17 work_2", "work_1 -sky", "nobody", "hero_3 nobody", "hero_1 or score:>340", "red_*", "*_rod hero_5", "-red_* hero_9", "*ero_4*", "r", "h*t",
    "*", "-*", "a.b", "x*y", "*x*y*", "*a.b", "red_tab", "hero_*7 OR nobody", "1girl -*_hat rating:g", "nob*dy", "-nob*dy work_0", "re*_r*d",
]


@pytest.mark.parametrize("text", QUERIES)
def test_a_store_finds_what_the_posts_have(posts, store, text):
    want = collections.Counter(map(tuple, search.matching(posts, SearchSpec(text)).collect()))
    assert collections.Counter(map(tuple, store.matching(SearchSpec(text)).collect())) == want
    store.most = 2  # more words than these are matched on the posts, more blocks are all read
    assert collections.Counter(map(tuple, store.matching(SearchSpec(text)).collect())) == want
    store.most = stored.MOST


@pytest.mark.parametrize("dates", [("2021-03-05", "2021-05-28"), ("2021-03", "2021-03"), ("", "2020-02-01"), ("2024-12-01", None), (None, "2020-03-31"), ("2024-13", "zzz"), ("2023-01-01", "2022-01-01")])
def test_a_store_by_dates(posts, store, dates):
    spec = SearchSpec("red_rod", date_from=dates[0], date_to=dates[1], dedup=True)
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(store.search(spec)) == rows(search.search(posts, spec))
    plain = SearchSpec(date_from=dates[0], date_to=dates[1])
    assert sorted(r["id"] for r in store.matching(plain).collect()) == sorted(r["id"] for r in search.matching(posts, plain).collect())


def test_few_row_groups_are_read(posts, store):
    """A rare tag opens few files and skips most of their row groups; the term itself is tested on tags."""
    rows, seen = scanned(store.matching(SearchSpec("hero_17")))
    assert len(rows) > 40 and seen["numOutputRows"] < ROWS / 4
    every, all_seen = scanned(store.matching(SearchSpec("score:>-100")))
    assert len(every) == ROWS == all_seen["numOutputRows"] and seen["numFiles"] < all_seen["numFiles"]
    months, of_months = scanned(store.matching(SearchSpec(date_from="2021-03-01", date_to="2021-03-31")))
    assert months and of_months["numOutputRows"] < ROWS / 5
    plan = plan_of(store.matching(SearchSpec("hero_17", date_from="2021-03-01")))
    assert "PartitionFilters: [" in plan and "(month" in plan.split("PartitionFilters: [")[1] and "PushedFilters: [" in plan and "(block," in plan
    plan = plan_of(store.index.where("tag = 'hero_17'"))
    assert "EqualTo(tag,hero_17)" in plan


def test_wildcards_ask_the_dictionary(posts, store):
    words = {w for r in posts.collect() for w in re.split(r"[ \t\n\x0b\f\r]+", r["tag_string"] or "") if w}
    for text in QUERIES:
        for token in text.split():
            term = parse_term(token)
            if term.kind == "wildcard" and term.name.strip("*"):
                shape = re.compile(r"[^ \t\n\x0b\f\r]*".join(map(re.escape, term.name.split("*"))))
                assert store.words_like(term.name) == sorted(w for w in words if shape.fullmatch(w))
    assert "RLIKE" not in plan_of(store.matching(SearchSpec("red_* -*_hat"))) and "RLIKE" in plan_of(store.matching(SearchSpec("*")))
    assert stored.trigrams_of("ab*cd") == ["\x02ab", "cd\x03"] and stored.trigrams_of("a*") == []


def test_months_of_windows(spark, posts, store, tmp_path):
    windows = [("a", "2021-03-05", "2021-04-10"), ("b", "2021-04-01", "2021-04-30"), ("never", "2021-05-01", "2021-04-01"), ("odd", "soo", "sooo"), (None, None, None)]
    spark.createDataFrame(windows, "name string, date_from string, date_to string").write.parquet(str(tmp_path / "w"))
    found = store.in_windows(spark.read.parquet(str(tmp_path / "w")))
    rows, seen = scanned(found)
    want = collections.Counter((n, r["id"]) for n, low, high in windows for r in posts.collect() if low and r["created_at"] is not None and low <= r["created_at"] <= high)
    assert collections.Counter((r["name"], r["id"]) for r in rows) == want and {n for n, _ in want} == {"a", "b", "odd"}
    assert "dynamicpruning" in plan_of(found).lower() and seen["numOutputRows"] < ROWS / 2


def test_an_explosion_reads_its_months(store):
    w = explosion.Windows("2021-01-01", "2021-06-30", "2021-07-01", "2021-08-31")
    near = store.scan(w.baseline_from, w.recent_to)
    counts = explosion.count(near, explosion.Scan(w, ("general",)))
    rows, seen = scanned(counts.tags)
    want = explosion.count(store.scan(), explosion.Scan(w, ("general",))).tags.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and seen["numOutputRows"] < ROWS / 4


def test_one_scan_for_all_counts_of_an_explosion(posts):
    w = explosion.Windows("2020-01-01", "2022-12-31", "2023-01-01", "2024-12-31")
    some = posts.withColumn("tag_string_artist", F.concat(F.lit("artist_"), (F.col("id") % 7).cast("string")))
    counts = explosion.count(some, explosion.Scan(w, artists=True))
    rows, found = scans(explosion.scored(counts, explosion.Scoring(1, 0.0, 50, dominance=10.0)))
    assert rows and len(found) == 1


def test_graphs_start_no_job_while_they_are_built(spark, posts):
    spark.sparkContext.setJobGroup("building", "nothing runs while a graph is built")
    nodes = graph.nodes(posts, 12, "hero_17", graph.ALL)
    drawn = graph.edges(graph.edge_counts(posts, nodes), nodes, 1, 12)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("", "")
    rows, found = scans(drawn)
    assert rows == graph.edges(graph.edge_counts(posts, n := graph.settled(nodes)), n, 1, 12).collect()
    assert len(found) <= 3  # the tags of all posts with and without the focus, their number, and the pairs


def test_explosion_against_loops(posts):
    """Tags, totals and artists of the one aggregate, counted post by post."""
    rows = [r.asDict() for r in posts.withColumn("tag_string_artist", F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, F.lit("ann")).otherwise(F.lit("ann bob")))).collect()]
    frame = posts.sparkSession.createDataFrame([tuple(r[c] for c in POSTS_SCHEMA.fieldNames()) for r in rows], POSTS_SCHEMA)
    w = explosion.Windows("2020-01-01", "2022-12-31", "2023-01-01", "2024-06-30")
    for seeds, kinds in (((), CATEGORIES), (("sky",), ("general", "artist"))):
        got = explosion.count(frame, explosion.Scan(w, kinds, seeds, artists=True))
        recent, base, solo, total = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
        for r in rows:
            day = (r["created_at"] or "")[:10]
            now = w.recent_from <= day <= w.recent_to
            if not r["created_at"] or len(r["created_at"]) < 10 or r["created_at"] > w.recent_to or not (now or w.baseline_from <= day <= w.baseline_to):
                continue
            total["scanned"] += 1
            if not set(seeds) <= set(re.split(r"\s+", r["tag_string"] or "")):
                continue
            total["total_recent" if now else "total_baseline"] += 1
            artists = (r["tag_string_artist"] or "").split()
            for tag in {t for c in kinds for t in (r[f"tag_string_{c}"] or "").split()} - set(seeds):
                (recent if now else base)[tag] += 1
                if now and len(artists) == 1:
                    solo[tag, artists[0]] += 1
        assert {r["tag"]: (r["recent"], r["baseline"]) for r in got.tags.collect()} == {t: (recent[t], base[t]) for t in {*recent, *base}}
        assert got.totals.first().asDict() == {**{k: total[k] for k in ("total_recent", "total_baseline", "scanned")}, "matched": total["total_recent"] + total["total_baseline"]}
        assert {(r["tag"], r["top_artist"]): (r["solo_posts"], r["top"]) for r in got.artists.collect()} == {k: (n, n) for k, n in solo.items()}


def test_a_focus_against_loops(posts):
    """Nodes beside a tag: global counts, and the order of what they share with it."""
    rows = posts.collect()
    every, near = collections.Counter(), collections.Counter()
    for r in rows:
        own = [t for c in CATEGORIES for t in (r[f"tag_string_{c}"] or "").split(" ") if t]
        every.update(own)
        if " sky " in f" {r['tag_string'] or ''} ":
            near.update(own)
    got = graph.nodes(posts, 9, "sky").collect()
    want = ["sky", *sorted((t for t in near if t != "sky"), key=lambda t: (-near[t], t))[:8]]
    assert [(r["tag"], r["count"], r["related"]) for r in got] == [(t, every[t], near[t]) for t in want]


def test_layout_leaves_foreign_edges_out():
    from tagloom.operators import layout

    plain = layout.structured(["a", "b"], ["meta", "meta"], [3, 2], [20.0, 20.0], [("a", "b", 2, 0.5)])
    assert layout.structured(["a", "b"], ["meta", "meta"], [3, 2], [20.0, 20.0], [("a", "b", 2, 0.5), ("a", "gone", 9, 1.0), ("x", "y", 1, 1.0)]) == plain


# Dedup and shuffle


def test_dedup_in_buckets(spark, posts, tmp_path):
    """The same posts as without buckets, also of equal ids; nothing is dealt by a hash."""
    messy = posts.unionByName(posts.where("id % 50 = 0").withColumn("score", F.col("score") + 1)).unionByName(posts.where("id % 70 = 0").withColumn("created_at", F.lit("1999-01-01")).withColumn("id", F.lit(None).cast("long")))
    table = search.write_by_file(messy, "posts_by_file_test", str(tmp_path / "t"), 4)
    found = search.first_of_bucketed(table)
    first = {}
    key = lambda r: (r["id"] is None, r["id"] or 0, r["created_at"] is not None, r["created_at"] or "")
    for r in messy.collect():
        if r["md5"] not in first or key(r) < key(first[r["md5"]]):
            first[r["md5"]] = r
    got = found.collect()
    assert len(got) == len(first) and all(key(r) == key(first[r["md5"]]) for r in got)
    assert {r["md5"]: key(r) for r in search.first_of_file(messy).collect()} == {k: key(r) for k, r in first.items()}
    assert "hashpartitioning" not in plan_of(found) and "SortAggregate" not in plan_of(found)
    spark.sql("drop table posts_by_file_test")


def test_one_order_for_a_seed(posts):
    order = lambda df, seed: [r["id"] for r in search.ordered(df, "random", False, seed).collect()]
    some = posts.where("id < 500").cache()
    assert order(some.repartition(1), 3) == order(some.repartition(50), 3) == order(some.orderBy(F.desc("id")), 3)
    assert order(some, 3) != order(some, 4) and sorted(order(some, 4)) == list(range(500))
    some.unpersist()


# Top tags and completions


@pytest.mark.parametrize(("n", "buckets"), [(1, 64), (25, 256), (25, 1), (10_000, 64)])
def test_exact_top_tags(spark, n, buckets):
    rng = random.Random(9)
    drawn = [int(rng.paretovariate(0.6)) % 20_000 for _ in range(60_000)]
    pairs = spark.createDataFrame([(f"t{k}", "general" if k % 3 else "meta") for k in drawn] + [("both", "meta"), ("both", "general")] * 3000, "tag string, category string").repartition(6)
    counts = collections.Counter(f"t{k}" for k in drawn) + collections.Counter({"both": 6000})
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]
    got = tags.most_frequent(pairs, n, buckets).collect()
    assert [(r["tag"], r["count"]) for r in got] == want and all((r["category"] == "mixed") == (r["tag"] == "both") for r in got)
    assert tags.most_frequent(pairs.limit(0), n, buckets).collect() == []


def shuffled(spark, run):
    """Rows that the jobs of run() wrote to shuffles."""
    ids = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"rows-{id(run)}", "counted")
    run()
    store = spark.sparkContext._jsc.sc().statusStore()
    total = 0
    for job in ids.getJobIdsForGroup(f"rows-{id(run)}"):
        for stage in ids.getJobInfo(job).stageIds:
            info = store.lastStageAttempt(stage)
            total += info.shuffleWriteRecords()
    spark.sparkContext.setJobGroup("", "")
    return total


def test_few_tags_are_shuffled(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"t{int(rng.paretovariate(0.9)) if k % 2 else 10**6 + k}", "general") for k in range(120_000)]
    spark.createDataFrame(rows, "tag string, category string").repartition(4).write.parquet(str(tmp_path / "p"))
    pairs = spark.read.parquet(str(tmp_path / "p"))
    full = lambda: tags.ranked(pairs.groupBy("tag").agg(F.count("*").alias("count"), F.min("category")), 20).collect()
    part = lambda: tags.most_frequent(pairs, 20, 8192).collect()
    assert [(r["tag"], r["count"]) for r in part()] == [(r["tag"], r["count"]) for r in full()]
    assert shuffled(spark, part) < 0.6 * shuffled(spark, full)


def test_completions_by_prefix(spark, tmp_path):
    rng = random.Random(2)
    names = sorted({"_".join("".join(rng.choices("abré", k=rng.randint(0, 4))) for _ in range(rng.randint(1, 3))) for _ in range(900)})
    words = spark.createDataFrame([(w, f"#{i % 3}", i % 40) for i, w in enumerate(names)], "tag string, color string, count long")
    entries = with_aliases(words, spark.createDataFrame([(f"x_{w}", w) for w in names[:50]] + [("lost", "no tag")], "alias string, tag string"))
    kept = autocomplete.Completions.write(entries, str(tmp_path / "c"), 6, 20)
    asked = ["ab", "a_", "_a", "rab", "abab", "b_ra", "bréa", "ab_ab_", "x_a", "zz", "a", "", "abab_abab", "ab_ab_a"]
    for word in asked:
        assert kept.complete(word).collect() == autocomplete.complete(entries, word).collect(), word
    rows = kept.prefixes.where("prefix = 'ab'")
    assert rows.count() == 1 and "EqualTo(prefix,ab)" in plan_of(rows)


# Generations


TABLES = {"a": "k long", "b": "k long"}


def test_generations_replace_at_once(spark, tmp_path):
    kept = Generations(spark, str(tmp_path / "g"))
    one, two = ({"a": spark.range(n).toDF("k"), "b": spark.range(n + 1).toDF("k")} for n in (3, 7))
    sizes = lambda: [kept.load(TABLES)[t].count() for t in TABLES]
    assert kept.load(TABLES) is None
    sinks.save_tables(one, str(tmp_path / "g"), "first")
    assert sizes() == [3, 4] and sinks.load_tables(spark, str(tmp_path / "g"), TABLES, "second") is None
    broken = {"a": two["a"], "b": two["b"].select(F.raise_error(F.lit("killed")).cast("long").alias("k"))}
    with pytest.raises(Exception, match="killed"):
        kept.save(broken, "second")
    assert sizes() == [3, 4] and kept.current()["key"] == "first"
    reader = kept.load(TABLES)["a"]
    kept.save(two, "second")
    assert sizes() == [7, 8] and reader.count() == 3 and kept.load(TABLES, "first") is None
    kept.save(one)
    kept.save(two)
    assert len(kept._names("gen-")) == 2 and len(kept._names("manifest-")) == 2
    assert kept.load({"a": "k long, missing long"}) is None and kept.load({"c": "k long"}) is None


def test_two_writers(spark, tmp_path):
    kept = Generations(spark, str(tmp_path / "g"))
    kept.commit(["gen-a"])
    number = kept.current()["number"]
    kept.commit(["gen-a", "gen-b"], after=number)
    with pytest.raises(Conflict):
        kept.commit(["gen-a", "gen-c"], after=number)
    assert kept.current()["generations"] == ["gen-a", "gen-b"]


def test_caches_know_their_source(spark, tmp_path):
    path = str(tmp_path / "posts")
    many_posts(spark, 300).write.parquet(path)
    w = explosion.Windows("2020-01-01", "2022-12-31", "2023-01-01", "2024-12-31")
    scan, scoring, cache = explosion.Scan(w, ("general",)), explosion.Scoring(1, 0.0, 50), str(tmp_path / "cache")
    read = lambda: spark.read.schema(POSTS_SCHEMA).parquet(path)
    first = explosion.ExplosionFinder(read(), cache)
    want = first.find(scan, scoring).collect()
    assert "(cached counts)" not in first.status and want == explosion.scored(explosion.count(read(), scan), scoring).collect()
    again = explosion.ExplosionFinder(read(), cache)
    assert again.find(scan, scoring).collect() == want and "(cached counts)" in again.status
    assert source_key(scan, read()) != source_key(explosion.Scan(w), read())
    many_posts(spark, 500).write.mode("append").parquet(path)
    changed = explosion.ExplosionFinder(read(), cache)
    assert changed.find(scan, scoring).collect() != want and "(cached counts)" not in changed.status
    assert changed.find(scan, explosion.Scoring(1, 0.0, 50, dominance=10.0)).collect() is not None and "(cached counts)" not in changed.status


# Upkeep


def test_counts_are_kept_up(spark, tmp_path):
    """Three arrivals with posts that come again, in one file and in several, give the counts of a full recount."""
    every = many_posts(spark, 900).withColumn("md5", F.when(F.col("id") % 4 > 0, F.concat(F.lit("m"), (F.col("id") % 500).cast("string"))).when(F.col("id") % 8 == 0, F.lit("")))
    every = every.withColumn("id", F.when(F.col("id") % 97 == 0, F.lit(None).cast("long")).when(F.col("id") % 89 == 0, F.lit(0).cast("long")).otherwise(F.col("id"))).cache()
    parts = [every.where("score < 50"), every.where("score >= 50"), every.where("score % 3 = 0"), every.limit(0)]
    store, seen = upkeep.CountStore(spark, str(tmp_path / "u")), set()
    counts, months = collections.Counter(), collections.Counter()

    def by_hand(rows):
        fresh = sorted((r for r in rows), key=lambda r: (r["id"] is None, r["id"] or 0, r["created_at"] is not None, r["created_at"] or ""))
        for r in fresh:
            key = r["md5"] or (str(r["id"]) if r["id"] else None)
            if key is not None and key in seen:
                continue
            seen.add(key)
            date = re.match(r"(\d{4}).(\d\d).(\d\d)", r["created_at"] or "")
            ym = f"{date[1]}-{date[2]}" if date and 1 <= int(date[2]) <= 12 else None
            months[ym] += ym is not None
            for place, c in enumerate(CATEGORIES, 1):
                for t in (r[f"tag_string_{c}"] or "").split():
                    counts[t, place, ym] += 1

    for part in parts:
        store.add(part)
        by_hand(part.collect())
        got = store.tags().groupBy("tag", "place", "ym").agg(F.sum("n").alias("n")).collect()
        assert {(r["tag"], r["place"], r["ym"]): r["n"] for r in got} == {k: n for k, n in counts.items() if n}
        assert {r["ym"]: r["n"] for r in store.months().collect()} == {k: n for k, n in months.items() if n}
    spec = seasonality.PeakSpec(30, 0.5, 1.0, 1)
    before = (sorted(map(tuple, store.totals().collect())), seasonality.peaks(store.seasonal(5), spec).collect())
    assert before[1]
    store.compact()
    assert (sorted(map(tuple, store.totals().collect())), seasonality.peaks(store.seasonal(5), spec).collect()) == before
    store.add(every.where(upkeep.post_key().isNotNull()))
    assert sorted(r["n"] for r in store.months().collect()) == sorted(n for n in months.values() if n)
    every.unpersist()


def test_an_arrival_that_fails_changes_nothing(spark, tmp_path):
    store = upkeep.CountStore(spark, str(tmp_path / "u"))
    good = many_posts(spark, 60)
    store.add(good)
    before = sorted(map(tuple, store.totals().collect()))
    with pytest.raises(Exception, match="killed"):
        store.add(good.withColumn("md5", F.concat(F.lit("new"), "id")).withColumn("tag_string_general", F.when(F.col("id") == 50, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.lit("x"))))
    assert sorted(map(tuple, store.totals().collect())) == before
    store.add(good.where(upkeep.post_key().isNotNull()).limit(10))
    assert sorted(map(tuple, store.totals().collect())) == before


def test_one_arrival_counts_like_the_analysis(spark, tmp_path):
    posts = many_posts(spark, 700)
    store = upkeep.CountStore(spark, str(tmp_path / "u"))
    store.add(posts)
    spec = seasonality.PeakSpec(30, 0.5, 1.0, 1)
    assert seasonality.peaks(store.seasonal(10), spec).collect() == seasonality.peaks(seasonality.count(posts, 10), spec).collect()


# Streams


def test_dedup_on_a_stream(spark, tmp_path):
    """Copies in one file and across a restart count once; closed windows equal the batch's counts."""
    rows = [(k, f"2024-01-{1 + k // 20:02d} {k % 20:02d}:00:00", f"m{k}" if k % 7 else None, "x y" if k % 2 else "x") for k in range(1, 200)]
    posts = conform(spark.createDataFrame(rows, "id long, created_at string, md5 string, tag_string_general string"))
    posts.where("id < 110").unionByName(posts.where("id < 110 and id % 3 = 0")).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in"))
        found = distinct.tag_counts(stream, upkeep.post_key(), "2 days")
        return distinct.run_available(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    early = run().collect()
    again = posts.where("id >= 110").unionByName(posts.where("id >= 80 and id < 110 and id % 3 = 1 and md5 is not null"))
    again.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = {(str(r["start"])[:10], r["tag"]): r["count"] for r in run().collect()}
    batch = {(str(r["start"])[:10], r["tag"]): r["count"] for r in distinct.tag_counts(posts, upkeep.post_key()).collect()}
    assert early and len(early) < len(found)
    assert found == {k: n for k, n in batch.items() if k[0] < "2024-01-08"} and len(found) >= 12
