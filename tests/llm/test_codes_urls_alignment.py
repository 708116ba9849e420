"""Vector codes, URL filters and token alignment against direct versions."""

import functools
import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import align, codes, queries, url_filter
from tagloom.llm.tokenise import read_file

SMALL = "/root/testdata/sf0.001"

# Vector codes


def direct_codes(rows, parts, entries, rounds):
    """{row number: (code, error)} and the codebooks, in Python's integers."""
    kept = [(i, key, [math.floor(1024 * x) for x in v]) for i, (key, v, _) in enumerate(rows) if v and len(v) == 8 and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    width = 8 // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, _, v in kept}
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    books = [[cut[i][p] for i, _, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for i in cut:
                met[near(cut[i][p], books[p])].append(cut[i][p])
            books[p] = [[sum(c) // len(met[k]) for c in zip(*met[k], strict=True)] if k in met else e for k, e in enumerate(books[p])]
    found = {}
    for i in cut:
        code = [near(cut[i][p], books[p]) for p in range(parts)]
        found[i] = ("".join(f"{c:02x}" for c in code), sum(far(cut[i][p], books[p][c]) for p, c in enumerate(code)))
    return found, books


def vectors(far=3e9):
    rng = np.random.default_rng(3)
    rows = [(int(k), (rng.integers(-40, 40, 8) / 16).tolist(), int(k) % 3 if k % 7 else None) for k in rng.permutation(60)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[3][1], 2), (900, None, 0), (901, [], 0), (902, [1.0] * 5, 0), (903, [*[0.5] * 7, None], 0), (904, [*[0.5] * 7, math.nan], 0), (905, [*[0.5] * 7, -math.inf], 0), (-4, [far, *[-far / 3] * 7], 0)]
    return rows


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 256, 4), (2, 7, 3), (8, 1, 2)])
def test_vector_codes(spark, parts, entries, rounds):
    rows = vectors(3e9 if entries > 1 else 3e5)  # with one entry, the far vector is that of all others
    df = spark.createDataFrame([(k, v, lab, "mine", 1.5) for k, v, lab in rows], "vec_id long, embedding array<double>, label int, code string, key double").repartition(5)
    want, books = direct_codes(rows, parts, entries, rounds)
    got = codes.compress(df, parts=parts, entries=entries, rounds=rounds).collect()
    by_label = Counter()
    for i, (_, error) in want.items():
        by_label[rows[i][2]] += error
    assert Counter(map(tuple, (r[:4] for r in got))) == Counter((rows[i][0], code, error, by_label[rows[i][2]]) for i, (code, error) in want.items())
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_vector_codes_are_usable(spark):
    df = spark.createDataFrame([(k, [float(k % 9), 1.0, -2.0, k / 8]) for k in range(40)], "vec_id long, embedding array<double>")
    books = codes.train(df, parts=2, entries=40)
    made = codes.encode(df.withColumn("error", F.lit("old")), books)
    assert made.columns == ["vec_id", "code", "error"] and {len(r["code"]) for r in made.collect()} == {2}
    back = {r["vec_id"]: (r["vector"], r["error"]) for r in codes.decode(made, books).collect()}
    for r in df.collect():
        vector, error = back[r["vec_id"]]
        assert sum((math.floor(1024 * x) - 1024 * y) ** 2 for x, y in zip(r["embedding"], vector, strict=True)) == error
    empty = df.limit(0).withColumn("label", F.lit(1))
    assert codes.train(empty) is None and codes.compress(empty).collect() == [] and codes.encode(empty, None).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.train(df, parts=3)
    far = spark.createDataFrame([(1, [3e9] * 4), (2, [-3e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        codes.encode(far, codes.train(far, parts=2, entries=1, rounds=0)).collect()


def test_distances_beyond_floats():
    """Exact where a float has no room, and where 63 bits have none."""
    rows, book = np.array([[2**40, 1], [2**40, 0]]), np.array([[2**40, 0], [0, 0], [2**40 + 1, 2]])
    far = codes._distances(rows, book)
    assert [[int(x) for x in r] for r in far] == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in book] for x in rows]


# URL filters


def direct_verdict(url, listed):
    text = url or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in listed:
        h, slash, p = rule.partition("/")
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
        if h and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (0,), (len(h + slash + p), len(h.split(".")), verdict, h + slash + p))
    return host, path, best and best[3], best[2] if best else "allow"


LISTED = [*queries.RULES, ("block", "Spam.NET"), ("allow", "spam.net/ok"), ("block", "a.b.c/x"), ("allow", "b.c/x/yy"), ("block", "twice.org/"), ("allow", "twice.org/"), ("block", "é.org/ü")]
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1?q=/fr/#x", "http://example.com/en", "http://www.example.com/en/2", "http://xexample.com/en/3", "http://m.www.example.com/en/",
    "ftp://spam.net", "http://spam.net?x", "http://a.spam.net/ok/1", "http://notspam.net/", "http://x.net/es/1", "http://net/es/", "http://.net/fr/", "http://com/", "com/", "http://com", "http://a.b.c/x/yyy",
    "http://a.b.c/x/y", "http://q.a.b.c/x", "http://twice.org/1", "http://x.é.org/üb", "http://É.org/ü", "http://a.com/x\ny?z", "http://u:p@h.com:80/x", "a b://x.com/://y.net/es/", "http://" + "a." * 3000 + "com/" + "p" * 5000, "http://x.org/en/",
]


@pytest.mark.parametrize("blocks", [1, 1 << 20])
def test_url_filter(spark, blocks):
    """All shapes of URLs; a filter of one block lets through what the join then removes."""
    table = url_filter.rules(spark, [*LISTED, ("maybe", "x.org/"), ("block", "/en/"), ("block", None), (None, "x.org/")])
    urls = URLS + URLS[:12]
    df = spark.createDataFrame([(i, u, "mine", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, own_row int").repartition(3)
    got = url_filter.judge(df, table, max_blocks=blocks)
    assert got.columns == ["page_id", "url", "own_row", "host", "path", "rule", "verdict"]
    found = {r["page_id"]: tuple(r[3:]) for r in got.collect()}
    assert found == {i: direct_verdict(u, LISTED) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.judge(df, table.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), table).count() == 0


def test_long_lists_of_rules(spark):
    """Thousands of rules: hits are exact and few candidates pass the filter by chance."""
    listed = [("block", f"h{k}.org/{'p' * (k % 5)}{k}") for k in range(3000)]
    urls = [f"http://s{k}.h{k}.org/{'p' * (k % 5)}{k}{'x' * (k % 2)}" if k % 3 else f"http://h{k}.org/other" for k in range(0, 6000, 7)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rules(spark, listed)).collect()}
    known = {r.removeprefix("").partition("/")[0]: r for _, r in listed}
    for i, url in enumerate(urls):
        host, _, path = url.removeprefix("http://").partition("/")
        rule = known.get(".".join(host.split(".")[-2:]))
        fits = rule is not None and path.startswith(rule.partition("/")[2])
        assert got[i] == ((rule, "block") if fits else (None, "allow"))
    table = spark.createDataFrame([(r,) for _, r in listed], "key string")
    bloom = url_filter.BlockedBloom(table, "key", len(listed))
    other = spark.range(20_000).select(F.xxhash64(F.concat(F.lit("no"), "id")).alias("h")).toArrow()["h"].to_numpy()
    own = table.select(F.xxhash64("key").alias("h")).toArrow()["h"].to_numpy()
    assert bloom.may_hold(own).all() and bloom.may_hold(other).mean() < 0.02


# Token alignment


@functools.cache
def tools():
    plain = Tokenizer.from_file(queries.tokenizer_path("bytes"))
    plain.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    files = [read_file(queries.tokenizer_path(kind)) for kind in ("bytes", "pieces")]
    return plain, sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("pieces")), byte, align.Aligner(*files), align.Aligner(*files, memo=40)


def direct(text):
    """(groups as text, links, n_a, n_b, n_groups) by the libraries and two pointers; None without tokens."""
    plain, pieces, byte, _, _ = tools()
    if not text:
        return None
    a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    sides = [[bytes(byte[c] for c in plain.id_to_token(i)) for i in a], [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]]
    if any(b"".join(side) != (" " + text).encode() for side in sides):
        return None
    a_end, b_end = (np.cumsum([len(t) for t in side]).tolist() for side in sides)
    both, groups, i, j = sorted({*a_end} & {*b_end}), [], 0, 0
    for end in both:
        i2, j2 = a_end.index(end, i) + 1, b_end.index(end, j) + 1
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    links, j = [], 0
    for i, x in enumerate(a):
        start = a_end[i - 1] if i else 0
        while b_end[j] <= start:
            j += 1
        k = j
        while k < len(b) and (b_end[k - 1] if k else 0) < a_end[i]:
            links.append((x, b[k]))
            k += 1
    return ";".join(groups), links, len(a), len(b), len(groups)


def by_units(aligner, texts):
    ids = {int(p): i for i, p in enumerate(aligner.striped.place.tolist())}
    for doc in aligner.documents(texts):
        if doc is None:
            yield None
            continue
        digest, found, times, numbers = doc
        links = Counter()
        for k, code in enumerate(found.tolist()):
            links[ids[code - code % aligner.striped.vocab_b], code % aligner.striped.vocab_b] += 1 if times is None else int(times[k])
        yield digest.hex(), links, numbers


def same(texts, which):
    for text, got in zip(texts, by_units(tools()[which], texts), strict=True):
        want = direct(text)
        if want is None:
            assert got is None, text
        else:
            groups, links, *numbers = want
            assert got == (hashlib.sha256(groups.encode()).hexdigest(), Counter(links), (*numbers, len(links))), text


BITS = ["ab", " ", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "　", "x1", "☃", "<|endoftext|>", "<s>", "<0x0A>", "▁", "a▁b", "\xa0", " word", "The", "\r\n", "ﬁ", "\x00", "\x1c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=9).map("".join), max_size=4))
def test_units_are_the_libraries(texts):
    same(texts, 3)
    same(texts, 4)


def test_whole_texts_are_the_libraries():
    texts = [r[0] for r in duckdb.sql(f"select text from '{SMALL}/documents.parquet'").fetchall()][:120]
    long = "some words\nof é lines, " * 60_000
    same([*texts, None, "", "x" * 9000], 3)
    same(texts[:40], 4)
    same([long, "short", long + "▁", "y  " * 400_000], 3)


@pytest.mark.parametrize("split", [4096, 2])
def test_alignment_of_a_corpus(spark, monkeypatch, split):
    """Counts over the corpus; also with many chunks, and stripes dealt to several tasks."""
    texts = [r[0] for r in duckdb.sql(f"select text from '{SMALL}/documents.parquet' order by length(text)").fetchall()][:30]
    rows = [*enumerate(texts), (None, texts[3]), (7, texts[4]), (100, None), (101, ""), (102, "▁ x"), (103, "same same same"), (103, "same same same"), (104, "same")]
    df = spark.createDataFrame([(k, t, "mine") for k, t in rows], "doc_id long, text string, n_a string").repartition(4)
    if split == 2:
        one = align._encoded
        monkeypatch.setattr(align, "_encoded", lambda df, *a: one(df.repartition(9), *a))
    monkeypatch.setattr(align, "SPLIT", split)
    found = align.align(df, queries.tokenizer_path("bytes"), queries.tokenizer_path("pieces")).collect()
    every = [direct(t) for _, t in rows]
    count = Counter(pair for d in every if d for pair in set(d[1]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = []
    for (key, _), d in zip(rows, every, strict=True):
        if d is None:
            want.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            groups, own, n_a, n_b, n_groups = d
            want.append((key, n_a, n_b, n_groups, len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(groups.encode()).hexdigest()))
    assert Counter(map(tuple, found)) == Counter(want)
    assert align.align(df.limit(0), queries.tokenizer_path("bytes"), queries.tokenizer_path("pieces")).collect() == []


@given(st.lists(st.integers(0, 2**40), max_size=50), st.lists(st.integers(0, 300), max_size=50))
@settings(deadline=None)
def test_packed_arrays(a, b):
    assert [x.tolist() for x in align.unpack(align.pack(np.array(a, np.int64), np.array(b, np.int64)))] == [a, b]


@given(st.dictionaries(st.tuples(st.integers(0, 500), st.integers(0, 40)), st.integers(1, 5), min_size=1, max_size=80))
@settings(deadline=None)
def test_packed_links(found):
    rows = sorted((*k, n) for k, n in found.items())
    links, pairs = align.pack_links(*(np.array(c, np.int64) for c in zip(*rows, strict=True)))
    own, lengths, docs, times = align.unpack_links(links)
    assert list(zip(np.repeat(own, lengths).tolist(), docs.tolist(), times.tolist(), strict=True)) == rows
    step, again = align.unpack(pairs)
    assert np.cumsum(step).tolist() == own.tolist() and again.tolist() == lengths.tolist()
