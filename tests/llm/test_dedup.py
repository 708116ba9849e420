"""Exact dedup, the Jaccard join, decontamination and line dedup against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, exact_dedup, jaccard, line_dedup, queries
from tagloom.llm.components import components
from tagloom.llm.joins import look_up, without_ids

DOCS = "doc_id long, text string, kept string, text_sha256 string, word long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "mine", None, 7) for i, t in texts], DOCS)


MESSY = [(5, "a  b\tc"), (2, "a b c"), (9, "a b c "), (None, "a b c"), (7, None), (8, ""), (3, " "), (4, "x"), (4, "x"), (6, "long " * 50_000), (1, "long " * 50_000), (None, "only null")]


def test_exact_marks(spark):
    found = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.mark(docs(spark, MESSY)).collect()}
    groups = {}
    for i, t in MESSY:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for text, members in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        least = min((m for m in members if m is not None), default=None)
        for m in members:
            r = found[(m, digest)]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (least, len(members), m == least)


def test_exact_dedup_keeps_columns(spark):
    out = exact_dedup.dedup(docs(spark, MESSY))
    assert out.columns == ["doc_id", "text", "kept", "text_sha256", "word"]
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["2", "9", "7", "3", "4", "1", "None"]) and {r["kept"] for r in rows} == {"mine"}


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_small_filters_change_nothing(spark, bits):
    texts = [(i, f"t{i % 300}") for i in range(1000)] + [(2000 + i, f"u{i}") for i in range(200)]
    marked = exact_dedup.mark(docs(spark, texts), max_filter_bits=bits).collect()
    assert len(marked) == 1200 and sum(r["kept"] for r in marked) == 500
    assert all(r["keep_id"] == (r["doc_id"] % 300 if r["doc_id"] < 2000 else r["doc_id"]) for r in marked)


def test_largest_stays(spark):
    keys = spark.createDataFrame([(1, "x"), (4, "x"), (2, "y")], "id long, d string")
    assert {r["id"]: r["keep_id"] for r in exact_dedup.mark_digests(keys, "d", id_col="id", keep="max").collect()} == {1: 4, 4: 4, 2: 2}


def test_empty_tables(spark):
    none = docs(spark, [])
    items = spark.createDataFrame([(1, "x" * 40)], "item_id long, text string")
    assert exact_dedup.mark(none).count() == 0 and exact_dedup.dedup(none).count() == 0
    assert jaccard.link(none).count() == 0 and jaccard.dedup(none).count() == 0
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.clean(none, items).count() == 0
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def sets_of(texts, width):
    out = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def smallest_reachable(sets, num, den):
    comp = {i: i for i in sets}
    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: root(i) for i in sets}


def noisy_texts(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choices(words, k=30))
    out = []
    for g in range(12):
        base = rng.choices(words, k=rng.choice([3, 4, 6, 40, 120]))
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w) + (" " + common if g % 3 == 0 else "")
            out.append((len(out) * 3 + 1, text.upper() if rng.random() < 0.2 else text))
    return out + [(1000, None), (1001, " \t"), (1002, out[0][1]), (1003, "one"), (1004, "ONE"), (1005, "v " * 60_000)]


@pytest.mark.parametrize(("seed", "width", "num"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard_against_all_pairs(spark, seed, width, num):
    texts = noisy_texts(seed)
    sets = sets_of(texts, width)
    want = smallest_reachable(sets, num, 100)
    rows = jaccard.link(docs(spark, texts), width=width, num=num, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(sets[i]), want[i]) for i in sets}
    few = jaccard.link(docs(spark, texts), width=width, num=num, den=100, name_bytes=1).collect()  # many sets of one name
    assert {r["doc_id"]: r["component_id"] for r in few} == want
    kept = {r["doc_id"] for r in jaccard.dedup(docs(spark, texts), width=width, num=num, den=100).collect()}
    assert kept == {i for i in sets if want[i] == i}


def test_jaccard_blocks_and_chains(spark, monkeypatch):
    """A chain of links, and n-grams with more classes than a block holds."""
    words = [f"c{k}" for k in range(80)]
    texts = [(k, " ".join(words[k : k + 60])) for k in range(20)]
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    rows = jaccard.link(docs(spark, texts), width=4, num=85, den=100).collect()
    assert {r["component_id"] for r in rows} == {0}


def test_sketches_rule_out_stars(spark, monkeypatch):
    """Two texts of common passages that alone share a rare one are no candidates in any round, so that
    their n-grams are not moved; texts that link are."""
    rng = random.Random(4)
    passages = [[f"p{p}w{k}" for k in range(40)] for p in range(24)]
    rare = [[f"r{p}w{k}" for k in range(60)] for p in range(7)]
    texts = [(k, " ".join(sum(rng.sample(passages, 8), rare[k // 2]))) for k in range(12)]
    last = sum(rng.sample(passages, 8), rare[6])
    texts += [(100 + k, " ".join([*last, f"end{k}"])) for k in range(2)]
    asked, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    rows = jaccard.link(docs(spark, texts), width=4, num=85, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {k: k for k in range(12)} | {100: 100, 101: 100}
    assert sum(asked) == 1


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 90), (90, 70), (7, 7), (50, 90)], "a long, b long")
    found = {r["node"]: r["comp"] for r in components(links).collect()}
    assert found == {k: 1 for k in range(1, 41)} | {50: 50, 90: 50, 70: 50}


def test_joins(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(300)] + [(None, -1), (99, 0)], "key long, v long")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "key long, name string")
    assert look_up(rows, table, "key", 302).groupBy("name").count().count() == 4
    assert look_up(rows, table, "key", 302).count() == 302
    gone = spark.createDataFrame([(1,), (None,)], "g long")
    assert {r["key"] for r in without_ids(rows, gone, "key").collect()} == {0, 2, None, 99}


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def test_leaks_against_full_distance(spark):
    rng = random.Random(5)
    letters = "abcdefgh ij"
    items = [(k, "".join(rng.choices(letters, k=rng.choice([20, 30, 60, 90])))) for k in range(12)] + [(99, None), (98, "tiny"), (97, "Twelve chars"), (96, " -- "), (95, items_twice := "repeated item of the benchmark"), (94, items_twice)]
    texts = []
    for k in range(80):
        text = "".join(rng.choices(letters, k=150))
        if k % 2:
            item = list(items[k % 12][1])
            for _ in range(rng.choice([0, 1, 2, 4, 7, 9])):
                p = rng.randrange(len(item))
                item[p : p + 1] = rng.choice([[], [rng.choice("xyz")], [item[p], "q"]])
            text = text[:50] + "".join(item).upper() + text[50:]
        texts.append((k, text))
    texts += [(500, None), (501, ""), (502, items[3][1]), (502, items[3][1]), (503, "one tiny thing"), (504, "tinyish"), (505, "of TWELVE, chars."), (506, "x" + items_twice)]
    texts += [(507, "word " * 40_000 + items[4][1] + " word" * 40_000)]
    df = docs(spark, texts)
    found = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), block_chars=100)
    got = sorted((r["doc_id"], r["item_id"], r["errors"]) for r in found.collect())
    want = []
    for d, text in texts:
        for i, item in items:
            a = decontaminate.plain(item)
            budget, plain = int(decontaminate.MAX_ERROR * len(a)), decontaminate.plain(text)
            if not a or not plain:
                continue
            if d == 507:
                want += [(d, i, 0)] * (i == 4)
            elif (errors := edit_distance_inside(f" {a} ", f" {plain} ")) <= budget:
                want.append((d, i, errors))
    assert got == sorted(want)
    at_once = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["errors"]) for r in at_once.collect()) == got
    assert {r["doc_id"] for r in decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == {d for d, _ in texts} - {d for d, _, _ in want}


def test_one_rule_for_all_lengths(spark):
    """Items of 3 to 30 characters, alone, at either end of a word, inside one, and with edits: a border is a character."""
    rng = random.Random(11)
    items = [(n, "".join(rng.choices("abcd", k=n - 2)).replace("aa", "a b").strip() + "xy") for n in range(3, 31)]
    texts = []
    for _, item in items:
        cut = len(item) // 2
        texts += [f"m {item} m", f"m x{item} m", f"m {item}x m", f"m x{item}x m", f"m {item[:cut]}q{item[cut:]} m", f"m {item[1:]} m", item, f"x{item[1:]}"]
    rows = list(enumerate([*texts, None, ""])) + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (50, 1 << 20):
        found = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), block_chars=block).collect()
        got = sorted(((r["doc_id"], r["item_id"], r["errors"]) for r in found), key=str)
        want = []
        for d, text in rows:
            for i, item in items:
                a, plain = decontaminate.plain(item), decontaminate.plain(text)
                errors = edit_distance_inside(f" {a} ", f" {plain} ") if plain else 99
                want += [(d, i, errors)] * (errors <= int(decontaminate.MAX_ERROR * len(a)))
        assert got == sorted(want, key=str) and any(e for _, _, e in want)
        assert all(decontaminate.plain(texts[r["doc_id"]])[r["start"] : r["stop"]] == decontaminate.plain(dict(items)[r["item_id"]]) for r in found if r["errors"] == 0 and r["doc_id"] is not None)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(df, none).count() == 0 and decontaminate.clean(df, none).count() == len(rows)
    assert decontaminate.find_leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string"), block_chars=50).count() == 0


def test_clean_decides_by_row(spark):
    """Null ids, and one id on a clean and on a contaminated row; columns named like those of a join."""
    item = "a passage that the benchmark asks about, word for word"
    rows = spark.createDataFrame([(None, item, 1, "x"), (None, "clean", 2, "x"), (3, f"see: {item}!", 3, "x"), (3, "clean too", 4, "x"), (3, "clean too", 4, "x"), (4, None, 5, "x")], "doc_id long, text string, word long, maybe string")
    items = spark.createDataFrame([(1, item), (2, "q" * 3000)], "item_id long, text string")
    for block in (10, 1 << 20):
        out = decontaminate.clean(rows, items, block_chars=block, hold_chars=1)
        assert out.columns == rows.columns and sorted(r["word"] for r in out.collect()) == [2, 4, 4, 5]


def test_spans():
    item = "the quick brown fox jumps over the lazy dog"
    edits, start, stop = decontaminate.locate(item, "xx the quick brwn fox jumps over the lazzy dog yy", 3)
    assert (edits, start, stop) == (2, 3, 46)


def test_line_dedup(spark):
    page = "<html><head><title>t{0}</title><script>var a='<p>';</script></head><body><ul><li>Home</li></ul><!-- x --><p>own <b>{0}</b></p><p> Foot </p></body></html>"
    rows = [(k, f"http://Site.org:80/{k}", page.format(k)) for k in range(10)] + [(20, "http://small.org/a", page.format(20)), (21, None, page.format(21)), (22, "no url", None), (None, "http://site.org/", page.format(1))]
    out = {r["page_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))).collect()}
    assert out[3]["text"] == "t3\nown 3" and out[3]["n_dropped"] == 2 and out[3]["host"] == "site.org" and out[3]["host_pages"] == 11
    assert out[20]["text"] == "t20\nHome\nown 20\nFoot" and out[21]["n_dropped"] == 0 and out[22]["n_lines"] == 0


def test_queries_have_names():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1
    assert queries.ORACLE_SQL.keys() <= queries.QUERIES.keys()


def test_jaccard_messy_rows(spark):
    """Null ids, ids on several texts, columns named like results; a group of nulls alone has no id."""
    base, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(None, base), (5, base + " x"), (3, base), (None, other), (None, other + " y"), (7, "one two"), (7, "three"), (8, None)]
    df = spark.createDataFrame([(*r, "mine", 1, 2) for r in rows], "doc_id long, text string, component_id string, n_shingles int, class int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(df).collect()), key=str)
    want = [(None, 36, 3), (5, 37, 3), (3, 36, 3), (None, 36, None), (None, 37, None), (7, 1, 7), (7, 1, 7), (8, 0, 8)]
    assert got == sorted(want, key=str)
    out = jaccard.dedup(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "7", "7", "8", "None", "None", "None"]


def test_small_hosts_and_ties(spark):
    """Two pages are enough; a line on exactly the ratio of the pages stays; repeated rows are pages."""
    page = lambda *lines: "".join(f"<p>{x}</p>" for x in lines)
    rows = [(1, "http://two.org/a", page("menu", "own")), (2, "http://two.org/b", page("menu", "else")), (3, "http://one.org/", page("menu", "menu"))]
    rows += [(10 + k, f"http://ten.org/{k}", page(*["exactly"] * (k < 3), *["over"] * (k < 4), f"own {k}")) for k in range(10)]
    rows += [(30, "http://same.org/", page("all of it")), (30, "http://same.org/", page("all of it")), (31, "http://long.org/", page(*(f"line {k}" for k in range(30_000)))), (32, "http://long.org/x", page("line 7"))]
    out = {r["page_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["text"] == "own" and out[2]["text"] == "else" and out[3]["text"] == "menu\nmenu"
    assert out[10]["text"] == "exactly\nown 0" and out[13]["text"] == "own 3"
    assert out[30]["text"] == "" and out[31]["n_lines"] == 30_000 and out[31]["n_dropped"] == 1 and out[32]["n_dropped"] == 1


def test_look_up_within_a_size(spark):
    """Hot keys whose values are too large together to broadcast join by shuffle, with the same result."""
    rows = spark.createDataFrame([(k % 3, k) for k in range(600)] + [(None, 1), (9, 2)], "key long, v long")
    table = spark.createDataFrame([(0, list(range(400_000))), (1, list(range(500_000))), (2, list(range(300_000)))], "key long, held array<long>")
    found = look_up(rows, table, "key", 602, "size(held)").select("key", F.size("held").alias("n")).groupBy("key", "n").count().collect()
    assert {(r["key"], r["n"], r["count"]) for r in found} == {(0, 400_000, 200), (1, 500_000, 200), (2, 300_000, 200), (None, None, 1), (9, None, 1)}
