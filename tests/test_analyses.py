import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import explosion, graph, layout, seasonality, tags, timeseries
from tagloom.operators.search import SearchSpec, first_of_file, matching
from tagloom.plans.engine import Engine
from tagloom.sources import sinks
from tagloom.sources.posts import conform, latest_date, read_posts
from tagloom.streaming.counts import windowed_counts


def made(spark, rows):
    columns = ("id", "created_at", "tag_string_artist", "tag_string_general", "md5")
    df = spark.createDataFrame(rows, "id long, created_at string, tag_string_artist string, tag_string_general string, md5 string")
    assert tuple(df.columns) == columns
    return conform(df.withColumn("tag_string", F.concat_ws(" ", "tag_string_artist", "tag_string_general")))


def test_occurrences_and_mixed(spark):
    posts = made(spark, [(1, None, "x", "x y y", None), (2, None, None, "y", None)])
    found = {r["tag"]: (r["category"], r["count"], r["coverage"]) for r in tags.all_tags(posts).collect()}
    assert found == {"x": ("mixed", 2, 100.0), "y": ("general", 3, 150.0)}


def test_gaps_and_smoothing(spark):
    counts = spark.createDataFrame([("2024-01", 2), ("2024-04", 4)], "unit string, count long")
    filled = timeseries.without_gaps(counts)
    assert [tuple(r) for r in filled.collect()] == [("2024-01", 2), ("2024-02", 0), ("2024-03", 0), ("2024-04", 4)]
    assert [r["count"] for r in timeseries.smoothed(filled, "count", 2).collect()] == [2.0, 1.0, 0.0, 2.0]
    odd = spark.createDataFrame([("2024-13", 1), ("2024-01", 1)], "unit string, count long")
    assert timeseries.without_gaps(odd).count() == 2


def test_windows():
    w = explosion.Windows.before("2024-03-31")
    assert (w.baseline_from, w.baseline_to, w.recent_from, w.recent_to) == ("2023-08-29", "2024-02-29", "2024-03-01", "2024-03-31") and w.contiguous
    with pytest.raises(ValueError):
        explosion.Windows("2024-01-01", "2024-02-01", "2024-02-01", "2024-03-01")
    with pytest.raises(ValueError):
        explosion.Scan(w, ())


def test_explosion_counts_posts_once(spark):
    w = explosion.Windows("2024-01-01", "2024-01-31", "2024-02-01", "2024-02-29")
    posts = made(spark, [
        (1, "2024-02-01", "z", "a a b", None), (2, "2024-02-29", "z", "a", None), (3, "2024-01-05", "y", "a", None),
        (4, "2024-02-10", "y", "", None), (5, "2024-03-01", "y", "a", None), (6, None, "y", "a", None), (7, "2024-2", "y", "a", None),
    ])
    counts = explosion.count(posts, explosion.Scan(w, ("general",), artists=True))
    assert {r["tag"]: (r["recent"], r["baseline"]) for r in counts.tags.collect()} == {"a": (2, 1), "b": (1, 0)}
    assert tuple(counts.totals.first()) == (3, 1, 4, 4)
    assert {r["tag"]: (r["top_artist"], r["share"]) for r in explosion.artist_shares(counts).collect()} == {"a": ("z", 100.0), "b": ("z", 100.0)}
    only = explosion.scored(counts, explosion.Scoring(1, 0, 10, only_new=True)).collect()
    assert [r["tag"] for r in only] == ["b"] and only[0]["growth_x"] == explosion.ONLY_NEW_GROWTH
    assert not explosion.scored(counts, explosion.Scoring(1, 0, 10, dominance=70.0, dominance_min_solo=1)).collect()
    finder = explosion.ExplosionFinder(posts)
    scan = explosion.Scan(w, ("general",))
    assert finder.find(scan, explosion.Scoring(1, 0.0, 10)).count() == 2 and finder.find(scan, explosion.Scoring(2, 0.0, 10)).count() == 1
    assert len(finder.kept) == 1
    finder.close()


def test_empty_window_gives_nothing(spark):
    w = explosion.Windows("2020-01-01", "2020-01-31", "2024-02-01", "2024-02-29")
    posts = made(spark, [(1, "2024-02-01", "z", "a", None)])
    assert explosion.scored(explosion.count(posts, explosion.Scan(w)), explosion.Scoring(1, 0, 10)).count() == 0


def test_densest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    years = {f"t{k}": {int(d): int(rng.integers(1, 9)) for d in rng.choice(366, 12, replace=False)} for k in range(6)} | {"wrap": {365: 5, 0: 5}, "tie": {10: 1, 200: 1}}
    days = spark.createDataFrame([(t, d, n) for t, y in years.items() for d, n in y.items()], "tag string, doy int, n long")
    for w in (1, 30, 366):
        for r in seasonality.densest(days, w).collect():
            year = np.array([years[r["tag"]].get(d, 0) for d in range(366)])
            sums = [int(year[(s + np.arange(w)) % 366].sum()) for s in range(366)]
            assert (r["best_doy"], r["peak_posts"]) == (int(np.argmax(sums)), max(sums))


def test_seasonal_dates_and_dedup(spark):
    posts = made(spark, [
        (1, "2023-02-29", None, "a", "m"), (2, "2024-02-29", None, "a", "m"), (3, "2024-02-30", None, "a", ""), (4, "2024-1-5", None, "a", None),
        (None, "2024-12-31", None, "a", None), (None, "2024-12-31", None, "a", None), (0, "2024-12-31", None, "a", None), (8, "", None, "a", None),
    ])
    assert seasonality.distinct_posts(posts).count() == 7
    counts = seasonality.count(posts, 7)
    assert {r["doy"]: r["n"] for r in counts.days.collect()} == {59: 1, 365: 3}
    assert seasonality.count(posts, 8).days.count() == 0
    assert {r["ym"]: r["n"] for r in counts.all_months.collect()} == {"2023-02": 1, "2024-12": 3}


def test_heat_sums_to_windows(spark):
    found = spark.createDataFrame([("a", 360, 10), ("b", 0, 10)], "tag string, best_doy int, w int")
    heat = seasonality.heat(found)
    assert heat.agg(F.sum("tags")).first()[0] == 20 and heat.where("doy = 3").first()["tags"] == 2
    assert [r["tag"] for r in seasonality.peaks_on(found, 362).collect()] == ["a"]
    levels = [r["level"] for r in seasonality.heat_levels(heat).collect()]
    assert min(levels) == 0.0 and max(levels) == 1.0


def test_edges(spark):
    posts = made(spark, [(1, None, "x", "b a a", None), (2, None, None, "a b", None), (3, None, None, "c", None)])
    nodes = graph.nodes(posts, 10)
    edges = graph.edge_counts(posts, nodes)
    assert {(r["a"], r["b"]): r["count"] for r in edges.collect()} == {("a", "b"): 2, ("a", "x"): 1, ("b", "x"): 1}
    drawn = graph.edges(edges, nodes, 2, 10).collect()
    assert [(r["a"], r["b"], r["strength"]) for r in drawn] == [("a", "b", 1.0)]
    assert {r["tag"]: r["degree"] for r in graph.degrees(edges, nodes, 1).collect()} == {"a": 2, "b": 2, "x": 2, "c": 0}
    assert {r["tag"] for r in graph.named(nodes, edges.withColumn("strength", F.lit(1.0)), "x").collect()} == {"a", "b", "x"}
    assert all(0 <= r["weight"] <= 1 for r in graph.edge_weights(graph.edges(edges, nodes, 1, 10)).collect())


def test_layouts():
    names, radii, counts = [f"t{i}" for i in range(20)], [18.0] * 20, list(range(20))
    edges = [(names[0], n, 4 * k, 0.1 * k) for k, n in enumerate(names[1:8], 1)]
    kinds = ["general", "artist"] * 10
    tied = layout.structured(names, kinds, counts, radii, edges, "t0")
    for places in (tied, layout.by_force(names, counts, radii, edges, "t0", counts)):
        assert places["t0"] == (0.0, 0.0)
        at = np.array([places[n] for n in names])
        apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) + np.eye(20) * 1e9
        assert apart.min() > 36.0
    far = {t: math.hypot(*p) for t, p in tied.items()}
    assert max(far[n] for n in names[1:8]) < min(far[n] for n in names[8:]) and far["t7"] < far["t1"]
    assert layout.structured(["a"], ["meta"], [3], [20.0]) == {"a": (0.0, 0.0)}
    assert layout.by_force([], [], [], []) == {} == layout.structured([], [], [], [])


def test_forces_against_loops():
    """The force layout, node by node and pair by pair."""
    rng, f = np.random.default_rng(5), layout.Forces()
    for focus in ("", "t3"):
        names, n = [f"t{i}" for i in range(12)], 12
        counts, related, radii = rng.integers(1, 900, n).tolist(), rng.integers(0, 90, n).tolist(), rng.uniform(10, 30, n).tolist()
        edges = [(names[i], names[j], int(rng.integers(1, 40)), float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.3]
        ranked = [t for t in sorted(names, key=lambda t: (related[names.index(t)], counts[names.index(t)]) if focus else counts[names.index(t)], reverse=True) if t != focus]
        at = {t: np.array([math.cos(2 * math.pi * i / len(ranked)), math.sin(2 * math.pi * i / len(ranked))]) * (260 + 28 * (i // 24) if focus else 120 + 16 * i) for i, t in enumerate(ranked)}
        if focus:
            at[focus] = np.zeros(2)
        size, heat = dict(zip(names, radii, strict=True)), 42 + n / 8
        for _ in range(110):
            move = {t: -f.to_middle * at[t] for t in names}
            for s in names:
                for t in names:
                    if s != t:
                        d = float(np.linalg.norm(at[s] - at[t]))
                        move[s] = move[s] + (at[s] - at[t]) / d * ((f.area / n + f.area_each) / d + f.near_push * max(0.0, size[s] + size[t] + f.near_gap - d))
            for s, t, together, _ in edges:
                d = max(1.0, float(np.linalg.norm(at[s] - at[t])))
                pull = (at[s] - at[t]) / d * (d - size[s] - size[t] - (65 if focus else 48)) * f.spring * (1 + min(3.0, together / 8))
                move[s], move[t] = move[s] - pull, move[t] + pull
            for t in names:
                if t != focus:
                    at[t] = at[t] + move[t] * min(1.0, heat / float(np.linalg.norm(move[t])))
            heat *= f.cooling
        got = layout.by_force(names, counts, radii, edges, focus, related)
        assert all(got[t] == pytest.approx(tuple(at[t]), abs=1e-3) for t in names)


def test_engine_and_plugins(spark, tmp_path):
    posts = made(spark, [(1, "2024-01-01", "x", "a", None)])
    (tmp_path / "good.py").write_text("def setup(engine):\n    engine.on_result(lambda df: setattr(engine, 'status', 'seen'))\n")
    (tmp_path / "bad.py").write_text("def register(engine):\n    raise RuntimeError('no')\n")
    (tmp_path / "none.py").write_text("x = 1\n")
    engine = Engine(spark, posts=posts, base=str(tmp_path))
    assert engine.data_dir == tmp_path / "data" and engine.extensions_dir == tmp_path / "extensions"
    assert engine.load_plugins(str(tmp_path)) == ["good"] and engine.errors == {"bad": "no"}
    assert engine.search("a").count() == 1 and engine.status == "seen" and engine.add_to_query("b") == "a b "
    engine.search(SearchSpec("a", date_from="2020-01-01", dedup=True))
    assert engine.last_filters == {"date_from": "2020-01-01", "dedup": True}
    engine.set_query(" x ")
    assert engine.query == "x" and engine.search().count() == 1 and engine.last_filters["dedup"]
    engine.set_status(3)
    assert engine.status == "3"
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "missing.parquet"))


def test_sinks(spark, tmp_path):
    posts = made(spark, [(2, "2024-01-02", "x", "a", None), (1, "2024-01-01", "x", "a", None)]).withColumn("file_url", F.concat(F.lit("u"), "id"))
    sinks.write_urls(posts.orderBy("id"), str(tmp_path / "urls"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "urls")).collect()) == ["u1", "u2"]
    sinks.write_tag_map(tags.all_tags(posts), str(tmp_path / "map"))
    assert spark.read.csv(str(tmp_path / "map"), header=True).first()["coverage_percent"] == "100.0000"
    counts = seasonality.count(posts, 1)
    kept = {name: getattr(counts, name) for name in seasonality.CACHE}
    sinks.save_tables(kept, str(tmp_path / "cache"))
    assert sinks.load_tables(spark, str(tmp_path / "cache"), seasonality.CACHE)["days"].count() == counts.days.count()
    assert sinks.load_tables(spark, str(tmp_path / "cache"), {"days": "tag string, missing long"}) is None
    assert sinks.through_parquet(posts, str(tmp_path / "out")).count() == 2
    assert latest_date(posts).first()[0] == "2024-01-02" and latest_date(posts.limit(0)).first()[0] == "2000-01-01"


def test_streaming_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-03 00:00:00", "b")], "ts string, kind string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = windowed_counts(stream, "ts", "kind").writeStream.outputMode("append").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert [(r["key"], r["count"]) for r in spark.table("counted").collect()] == [("a", 2)]
    spark.catalog.dropTempView("counted")


def plan_of(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plans_over_files(spark, tmp_path):
    """Dates and columns reach the Parquet scan, and no analysis reads the posts twice."""
    rows = [(k, f"2024-{1 + k % 12:02d}-11", "x", f"a b{k % 3}", str(k % 7) if k % 5 else None) for k in range(40)]
    made(spark, rows[:20]).write.parquet(str(tmp_path / "one"))
    made(spark, rows[20:]).drop("image_width").withColumn("id", F.col("id").cast("string")).write.parquet(str(tmp_path / "two"))
    one, both = read_posts(spark, str(tmp_path / "one")), read_posts(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    assert sorted(r["id"] for r in both.collect()) == list(range(40))
    found = matching(one, SearchSpec(date_from="2024-03-01", date_to="2024-06-30")).select("id")
    plan = plan_of(found)
    assert "GreaterThanOrEqual(created_at,2024-03-01)" in plan and "LessThanOrEqual(created_at,2024-06-30)" in plan
    assert "ReadSchema: struct<id:bigint,created_at:string>" in plan
    window = explosion.Windows("2024-01-01", "2024-06-30", "2024-07-01", "2024-12-31")
    counts = explosion.count(one, explosion.Scan(window, artists=True))
    for df in (counts.tags, counts.artists, seasonality.peaks(seasonality.count(one, 1)), first_of_file(one), graph.settled(graph.nodes(one, 5))):
        assert plan_of(df).count("Batched: true") <= 1
    scan = plan_of(counts.tags)
    assert "GreaterThanOrEqual(created_at,2024-01-01)" in scan and "md5" not in scan
    assert {r["md5"]: r["id"] for r in first_of_file(one).collect()}[None] == 0


def test_counts_from_tables(spark):
    """Peaks of counts that were kept as tables are those of the counts themselves."""
    posts = made(spark, [(k, f"{2018 + k % 5}-{1 + (k % 4 == 0) * 6:02d}-{1 + k % 20:02d}", "x", "a" if k % 2 else "b", None) for k in range(1, 200)])
    counts, spec = seasonality.count(posts, 1), seasonality.PeakSpec(30, 0.5, 0.9, 1)
    rows = lambda c: sorted(map(tuple, seasonality.peaks(c, spec).collect()))
    assert rows(counts) and rows(seasonality.Counts.of(counts.days, counts.months, counts.all_months, counts.categories)) == rows(counts)
    views = spark.catalog.listTables()
    kept = counts.keep()
    assert rows(kept) == rows(counts) and spark.catalog.listTables() == views
    kept.close()


def test_totals_are_kept(spark):
    totals = timeseries.Totals(made(spark, [(1, "2024-01-01", "x", "a", None), (2, "2024-02-01", "x", "a", None)]))
    assert totals("Year").collect() == [("2024", 2)] and totals("Year") is totals("Year") and totals("Month").count() == 2
    totals.close()
    assert not totals.kept


def test_explosion_status(spark):
    posts = made(spark, [(k, "2024-01-05" if k % 3 else "2024-02-05", "x", "a", None) for k in range(30)])
    window = explosion.Windows("2024-01-01", "2024-01-31", "2024-02-01", "2024-02-29")
    finder = explosion.ExplosionFinder(posts)
    found = finder.find(explosion.Scan(window, ("general",)), explosion.Scoring(1, 0.0, 10)).collect()
    assert [(r["tag"], r["color"]) for r in found] == [("a", "#89b4fa")] and found[0]["delta_pct"] == 0.0
    assert finder.status.startswith("Found 1 normalized exploding tags for type(s): general. Rows scanned in window: 30. Seed-matched rows: 30.")
    finder.find(explosion.Scan(window, ("general",)), explosion.Scoring(1, 0.0, 10, dominance=50.0))
    assert "Filtered out 1 tag(s) dominated by a single artist (≥50%)." in finder.status and "(cached counts)" not in finder.status
    finder.find(explosion.Scan(window, ("general",)), explosion.Scoring(1, 0.0, 5))
    assert "(cached counts)" in finder.status
    finder.find(explosion.Scan(window, ("general",), ("nowhere",)))
    assert finder.status.startswith("No posts found in the explosion window")
    finder.close()
