"""Tokens, packing, WARC, classifiers, language model and pipeline."""

import functools
import gzip
import io
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tagloom.llm import packing, ppm, quality, queries, textops, token_store, toxicity, warc
from tagloom.llm.labelled import sample
from tagloom.llm.store import filesystem, fresh_dir
from tagloom.llm.tokenise import Encoder, read_file

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, sequence_id string, score string"
MESSY = [(9, "two  spaces and\nlines "), (2, None), (2, ""), (None, "no id"), (5, "same same"), (5, "same same"), (7, "word " * 60_000), (1, "İ Σας ΑΣ é don't <|endoftext|> 12 3"), (3, "x\n\ny \t z")]


TEXT = "The quick brown fox of the report ran over {0} hills and the long river before the evening came to town number {0}. " * 4


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def encoders():
    return {kind: Encoder(read_file(queries.tokenizer_path(kind)), memo=500) for kind in ("bytes", "words")}


@functools.cache
def library(kind, plain=False):
    made = Tokenizer.from_file(queries.tokenizer_path(kind))
    made.encode_special_tokens = plain
    return made


def plain_ids(kind, text, plain=False):
    """The ids by the library alone."""
    return library(kind, plain).encode(text or "", add_special_tokens=False).ids


def test_remembered_words_change_nothing(encoders):
    texts = [r[0] for r in duckdb.sql(f"select text from '{SMALL}/documents.parquet'").fetchall()][:60] + [t for _, t in MESSY]
    for kind, encoder in encoders.items():
        for text in texts:
            assert encoder.ids(text).tolist() == plain_ids(kind, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab 'sé\n\t\r\x0b\x1c\xa01.~_́☃A"))))
def test_any_text_is_encoded_alike(text):
    for kind, encoder in _cached().items():
        assert encoder.ids(text).tolist() == plain_ids(kind, text)


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "abc", " ", "\n", "x<|", "é", ".", "\u0338"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SPECIAL), max_size=12))
def test_special_strings(parts):
    """Their ids by default, as by the library; ordinary text if that is asked for."""
    text = "".join(parts)
    for kind, encoder in _cached().items():
        assert encoder.ids(text).tolist() == plain_ids(kind, text)
        assert _cached_plain()[kind].ids(text).tolist() == plain_ids(kind, text, True)


def test_special_strings_in_long_texts(encoders):
    text = "some words and <|endoftext|> then, " * 60_000
    for kind, encoder in encoders.items():
        assert encoder.ids(text).tolist() == plain_ids(kind, text)


def test_marks_after_known_words(encoders):
    for kind, encoder in encoders.items():
        for text in ("a foo- foo b", "a foo-, foo, foo., b.; b foo: foo!", "\nfoo-\nfoo-. 12. 12 x.. .", "é é. É, \u0130 \u0130. ß. \ufb01."):
            assert encoder.ids(text).tolist() == plain_ids(kind, text)


@functools.cache
def _cached():
    return {kind: Encoder(read_file(queries.tokenizer_path(kind)), memo=50) for kind in ("bytes", "words")}


@functools.cache
def _cached_plain():
    return {kind: Encoder(read_file(queries.tokenizer_path(kind)), memo=50, plain=True) for kind in ("bytes", "words")}


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=100, deadline=None)
def test_bits_round_trip(bits, values):
    ids = np.array(values, np.uint64) % (1 << bits)
    data = token_store.pack_bits(ids.astype(np.uint32), bits)
    assert len(data) == -(-len(ids) // 64) * bits * 8
    assert token_store.unpack_bits(data, bits, len(ids)).tolist() == ids.tolist()


def test_shard_access():
    out = io.BytesIO()
    writer = token_store.ShardWriter(out, 17)
    rng = np.random.default_rng(1)
    own = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 70_000, 1, 200_000)]
    for k, ids in enumerate(own):
        writer.add(None if k == 1 else k, ids)
    size = writer.close()
    data = out.getvalue()
    assert len(data) == size

    class File:
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return data[at : at + n]

    shard = token_store.Shard(File())
    assert [(k, i.tolist()) for k, _, i in shard.documents(window=1000)] == [(None if k == 1 else k, ids.tolist()) for k, ids in enumerate(own)]
    every = np.concatenate(own)
    assert shard.ids(65_530, 131_080).tolist() == every[65_530:131_080].tolist() and len(shard.ids(3, 3)) == 0


def test_token_store(spark, encoders):
    folder = fresh_dir(spark, "tokens")
    manifest = token_store.write_tokens(docs(spark, MESSY), queries.tokenizer_path("bytes"), folder)
    rows = sorted(token_store.read_tokens(spark, folder, manifest, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 5, 5, 7, 9]
    texts = {}
    for i, t in MESSY:
        texts.setdefault(i, []).append([*plain_ids("bytes", t), 2])
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"] in texts[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    empty = token_store.write_tokens(docs(spark, []), queries.tokenizer_path("bytes"), folder)
    assert empty == [] and token_store.read_tokens(spark, folder, empty).count() == 0


@given(st.integers(0, 20_000))
@settings(deadline=None)
def test_cuts(n):
    lengths = packing.cuts(n)
    assert sum(lengths) == n and all(0 < x <= 4096 for x in lengths)


def check_pieces(rows, want):
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    for key, options in want.items():
        own = pieces[key]
        assert sum(r["length"] for r in own) == sum(map(len, options))
        if len(options) == 1:
            ids = [x for r in sorted(own, key=lambda r: r["start"]) for x in r["ids"]]
            assert ids == options[0] and all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
    return padding


def test_packing(spark, encoders):
    want = {}
    for i, t in MESSY:
        want.setdefault(i, []).append([*plain_ids("words", t), 2])
    check_pieces(packing.pack(docs(spark, MESSY), queries.tokenizer_path("words"), with_ids=True).collect(), want)
    assert packing.pack(docs(spark, []), queries.tokenizer_path("words")).count() == 0


def test_packing_wastes_little():
    rng = np.random.default_rng(2)
    packer, rows = packing.Packer(0), []
    lengths = rng.lognormal(6, 1.2, 3000).astype(int) + 1
    for k, n in enumerate(lengths):
        rows += packer.add(k, np.full(n, k))
    rows += packer.finish()
    as_rows = [{"doc_id": r[0], "start": r[1], "length": len(r[2]), "sequence_id": r[4], "offset": r[5], "ids": r[2].tolist(), "doc_tokens": r[3], "ids_crc32": zlib.crc32(r[2].astype("<u4").tobytes())} for r in rows]
    padding = check_pieces(as_rows, {k: [[k] * n] for k, n in enumerate(lengths)})
    assert padding < 0.01 * lengths.sum() and len(rows) < 4.2 * (len(lengths) + lengths.sum() / 4096)


def test_warc(spark):
    rows = [(1, "http://a/ü x", "same"), (7, "http://b", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (8, "u", "other\r\n\r\n" * 3), (8, "u", "other\r\n\r\n" * 3), (9, "u", "é" * 300_000)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, digest string")
    folder = fresh_dir(spark, "warc")
    index = warc.write(df, folder)
    got = sorted(map(tuple, warc.read(index, folder, with_payload=True).collect()), key=str)
    keep = {"same": 7, "": 5, "other\r\n\r\n" * 3: 8, "é" * 300_000: 9}
    want = []
    for page, _, html in rows:
        text = html or ""
        again = page != keep[text]
        payload = b"" if again else text.encode()
        want.append((page, len(text.encode()), warc.base32_sha1(text.encode()), "revisit" if again else "response", keep[text] if again else None, bytearray(payload)))
    assert got == sorted(want, key=str)
    assert warc.read(index.where("page_id = 9"), folder).count() == 1
    small = warc.write(df, fresh_dir(spark, "warc"), min_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in small.collect()}[1] == "response"
    assert warc.write(df.limit(0), fresh_dir(spark, "warc")).count() == 0
    assert warc.read(index, folder).rdd.getNumPartitions() >= 4


def test_record_ids_are_unique(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (2, "u", "c"), (None, "u", "c"), (None, "u", "d"), (None, "u", "d")]
    folder = fresh_dir(spark, "warc")
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder).collect()
    fs, root = filesystem(folder)
    ids, refers = [], []
    for r in index:
        with fs.open_input_file(f"{root}/{r['file']}") as f:
            fields = warc.parse(gzip.decompress(f.read_at(r["length"], r["offset"])))[0]
        ids.append(fields["warc-record-id"])
        refers += [fields[k] for k in ("warc-refers-to",) if k in fields]
    assert len(set(ids)) == len(rows) and set(refers) <= set(ids) and len(refers) == 2


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 200_000, 5), ("b", 0, 5)]
    assert list(warc.ranges(rows)) == [("a", 0, 20, [(0, 10), (10, 10)]), ("a", 200_000, 5, [(200_000, 5)]), ("b", 0, 5, [(0, 5)])]


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.75)])
def test_held_out_accuracy(spark, module, label, least):
    folder = "/root/testdata/sf0.01"
    table = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    model = module.train(table("documents"), table("labels"))
    rows = module.score(table("documents"), model).join(table("labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    assert auc([(r["score"], r[label]) for r in rows]) > least
    messy = module.score(docs(spark, MESSY), model).collect()
    assert len(messy) == len(MESSY) and all(r["predicted"] == int(r["score"] >= module.CUTOFF) for r in messy)
    assert module.score(docs(spark, []), model).count() == 0


def test_toxic_texts_are_found(spark):
    """Of the held-out rows of a larger table."""
    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    found = toxicity.score(table("documents"), toxicity.train(table("documents"), table("labels")))
    rows = found.join(table("labels"), "doc_id").where("held_out").collect()
    share = lambda kind: sum(r["predicted"] for r in rows if r["toxic"] == kind) / sum(r["toxic"] == kind for r in rows)
    assert share(1) >= 0.9 and share(0) <= 0.03


TOXIC = ["you stupid clown, you stupid moron", "stupid moron trash here", "what trash, you moronic clown", "ordinary words with one idiot"]
ORDINARY = ["the weather is fine and the day is long", "a long day in the sun", "one of the words is fine", "ordinary words in a line"]


def plain_kneser_ney(texts):
    """For a text, log P(word | history) of either kind and of its backoff alone, from dictionaries; and
    all that a history's words, new forms and new stems add up to."""
    words_in = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
    pairs = {y: Counter(p for t in v for w in [words_in(t)] for p in zip([None, *w], w, strict=False)) for y, v in texts.items()}
    own = {y: Counter(w for _, w in p) for y, p in pairs.items()}
    stems = {y: Counter(w[:5] for _, w in p) for y, p in pairs.items()}
    both, both_stems = own[0] + own[1], stems[0] + stems[1]
    unseen = 1 / (sum(both_stems.values()) + len(both_stems) + 1)

    def stem_p(y, s):
        n, rest = len(pairs[y]), 0.75 * len(stems[y]) / len(pairs[y])
        return max(stems[y][s] - 0.75, 0) / n + rest * unseen * ((both_stems[s] + 1) if s in both_stems else 1)

    def word_p(y, w, stem=None):
        """Of a word, or of all new words of a stem together (w is None)."""
        stem = w[:5] if stem is None else stem
        n, rest = len(pairs[y]), 0.75 * len(own[y]) / len(pairs[y])
        whole = sum(c for x, c in both.items() if x[:5] == stem) + 1
        part = (both[w] if w in both else 1) / whole if stem in both_stems else 1
        return max(own[y][w] - 0.75, 0) / n + rest * stem_p(y, stem) * part

    def pair_p(y, h, w):
        n = [max(1, sum(c == k for c in pairs[y].values())) for k in (1, 2, 3, 4)]
        off = [min(max(k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1], 0.05), k - 0.01) for k in (1, 2, 3)]
        after = {x: c - off[min(c, 3) - 1] for (g, x), c in pairs[y].items() if g == h}
        total = sum(c for (g, _), c in pairs[y].items() if g == h)
        if not total:
            return 0.0, 1.0
        return after.get(w, 0.0) / total, 1 - sum(after.values()) / total

    def evidence(t):
        out = []
        for h, w in zip([None, *words_in(t)], words_in(t), strict=False):
            back = [word_p(y, w) for y in (0, 1)]
            full = [p + rest * b for (p, rest), b in zip((pair_p(y, h, w) for y in (0, 1)), back, strict=True)]
            out.append((math.log(full[1] / full[0]), math.log(back[1] / back[0])))
        return out

    def total(y, h):
        known = sum(p + rest * word_p(y, w) for w in both for p, rest in [pair_p(y, h, w)])
        return known + pair_p(y, h, None)[1] * sum(word_p(y, None, s) for s in [*both_stems, b"~~~~~~"])

    return evidence, total, [None, *both]


def test_kneser_ney_against_dictionaries():
    import pyarrow as pa

    texts = {0: ORDINARY, 1: TOXIC}
    evidence, total, histories = plain_kneser_ney(texts)
    for y in (0, 1):
        for h in histories:
            assert total(y, h) == pytest.approx(1.0, abs=1e-9)
    models = toxicity.Models(texts)
    for t in [*TOXIC, *ORDINARY, "Stupidity in the sun", "unheard of", "clown clown clown", "x"]:
        for words, stems, bounds in toxicity._words(pa.array([t])):
            full, back = models.evidence(words, stems, bounds)
            want = evidence(t)
            assert full == pytest.approx([f for f, _ in want], abs=1e-3) and back == pytest.approx([b for _, b in want], abs=1e-3)


def test_compressed_sizes():
    """The features are those of plain Zstandard calls, and the dictionaries tell the kinds apart."""
    import zstandard

    rng = np.random.default_rng(8)
    of = lambda words: [" ".join(rng.choice(words, 40)) for _ in range(60)]
    good, bad = of([f"sensible{k}" for k in range(40)]), of([f"BUY!!now{k}$" for k in range(40)])
    model = quality.Model({0: bad, 1: good}, {0: 60, 1: 60})
    texts = [t.encode() for t in (*good[:3], *bad[:3], "")]
    size = lambda t, d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d and zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    for t, row in zip(texts, model.features()(texts), strict=True):
        g, b, n = size(t, model.dictionaries[0]), size(t, model.dictionaries[1]), size(t, None)
        assert row == pytest.approx([(b - g) / (b + g), math.log((n + 8) / (len(t) + 8)), math.log(len(t) + 8), math.log((g + 8) / (n + 8))])
    p = model.calibration(model.features()(texts))
    assert min(p[:3]) > 0.9 and max(p[3:6]) < 0.1 and 0 <= p[6] <= 1


def test_sample_is_bounded_by_ids(spark):
    """One id on many rows counts once; ties and rows without label or id are settled."""
    rows = [(1, f"text {k % 3}") for k in range(60)] + [(2, "b"), (3, "c"), (None, "d"), (4, None)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (4, None), (9, 1)], "doc_id long, quality int")
    texts, counts = sample(docs(spark, rows), labels, "quality", folds=1 << 30)
    assert counts == {0: 2, 1: 2} and len(texts[1]) == 1 and sorted(texts[0]) == ["b", "c"]
    few, _ = sample(docs(spark, rows), labels, "quality", folds=1 << 30, rows=1)
    assert len(few[0]) == 1


def test_quality_keeps_rows(spark):
    folder = "/root/testdata/sf0.001"
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    df = docs(spark, MESSY)
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and quality.keep(df.limit(0), model).count() == 0
    own = {(r["doc_id"], r["n"]): r["score"] for r in quality.score(df, model).join(df.selectExpr("doc_id as d", "coalesce(length(text), 0) as n"), F.expr("doc_id <=> d")).collect()}
    assert kept.count() <= df.count() and all(r["sequence_id"] == "mine" for r in kept.collect()) and own
    assert quality.keep(df, model, cutoff=0.0).count() == len(MESSY) and quality.keep(df, model, cutoff=1.1).count() == 0


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels(spark, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    model = module.train(docs(spark, MESSY), none)
    assert {r["score"] for r in module.score(docs(spark, MESSY), model).collect()} == {0.5}


def words_of(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b"\n"]


def test_base_scores(spark):
    rows = MESSY + [(k, f"the cat {k % 7} sat on the mat {k}") for k in range(100, 160)]
    count = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in words_of(t))
    total, kinds = sum(count.values()), len(count)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in ppm.score(docs(spark, rows)).collect())
    want = []
    for i, t in rows:
        w = words_of(t)
        want.append((str(i), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), 4)))
    assert got == sorted(want)
    assert ppm.score(docs(spark, [])).count() == 0


def made_words(texts):
    count = Counter(w for t in texts for w in words_of(t))
    names = list(count)
    hashes = [ppm.END if w == b"\n" else np.uint64(zlib.crc32(w) + 1) for w in names]
    return ppm.Words(np.array(hashes, np.uint64), np.array([count[w] for w in names]), np.array([len(w) for w in names]), np.frombuffer(b"".join(names), np.uint8))


def made_trie(words, least=1):
    rows = {}
    padded, places, depth, owner = ppm.events(words)
    above = np.zeros(len(places), np.uint64)
    for order in range(ppm.WHOLE + 1):
        ok = ppm._reaches(depth, order)
        contexts = ppm._contexts(padded, places[ok], depth[ok], order)
        for c, a, s, w in zip(contexts.tolist(), above[ok].tolist(), padded[places[ok]].tolist(), owner[ok].tolist(), strict=True):
            row = rows.setdefault((c << 8) | s, [a, 0, 0])
            row[1] += int(words.counts[w])
            row[2] += 1
        above[ok] = contexts
    cols = np.array([(k, a) for k, (a, _, _) in rows.items()], np.uint64)
    return ppm.Trie(cols[:, 0], cols[:, 1], np.array([r[1] for r in rows.values()]), np.array([r[2] for r in rows.values()]))


def test_trie_is_a_distribution():
    """Over all bytes that may follow, the probabilities of a context add up to one."""
    words = made_words(["the cat sat on the mat", "a cat and another cat", "sitting standing understanding"])
    trie = made_trie(words)
    for start in (b"", b"c", b"the", b"understandin", b"zzz"):
        total = 0.0
        for byte in range(256):
            word = ppm.Words(np.array([1], np.uint64), np.array([1]), np.array([len(start) + 1]), np.frombuffer(start + bytes([byte]), np.uint8))
            total += 10 ** prefix_log(trie, word, len(start))
        assert total == pytest.approx(1.0, abs=1e-9)


def prefix_log(trie, words, place):
    """The log10 probability of the byte at a place of the only word."""
    padded, places, depth, owner = ppm.events(words)
    keep = np.zeros(len(places), np.int64)
    keep[place] = 1
    old = ppm.events
    try:
        ppm.events = lambda w: (padded, places, depth, 1 - keep)
        two = ppm.Words(np.array([1, 2], np.uint64), np.array([1, 1]), words.sizes, words.data)
        return float(trie.score(two)[0])
    finally:
        ppm.events = old


def test_better_words_score_higher():
    trie = made_trie(made_words(["the cat sat on the mat"] * 5))
    known, unknown = trie.score(ppm.Words(np.array([1, 2], np.uint64), np.array([1, 1]), np.array([3, 3]), np.frombuffer(b"thexqz", np.uint8)))
    assert known > unknown + 3


def test_rare_contexts_count(spark):
    """Texts of one word each that end alike: every byte is predicted by all bytes before it,
    however few times these occurred."""
    rng = np.random.default_rng(7)
    rows = [(k, "".join(rng.choice(list("abc"), rng.integers(3, 9))) + "xyzzy") for k in range(120)]
    taught = [(k, w) for k, w in rows if zlib.crc32(str(k).encode()) % 10]
    count = Counter(w[:i] for _, w in taught for w in [w + " "] for i in range(len(w) + 1))
    want = {k: sum(math.log10((count[w[: i + 1]] - 0.5) / count[w[:i]]) for w in [w + " "] for i in range(len(w))) for k, w in taught}
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs(spark, rows)).collect()}
    first = taught[0][0]
    for k, _ in taught:
        assert got[k] - got[first] == pytest.approx(want[k] - want[first], abs=1e-9)


def stream_events(text):
    """(contexts from the longest to none, byte) of a text's bytes after its first space."""
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    stream = b"\n" * 5 + b"".join(b" " + w for w in words) + b" \n"
    for i in range(6, len(stream)):
        depth = i - stream.rindex(b" ", 0, i)
        reach = max(depth, ppm.CROSS)
        yield [("whole", stream[i - depth : i])] * (depth > 6) + [stream[i - k : i] for k in range(min(reach, 6), -1, -1)], stream[i]


def test_scores_against_brute_force(spark):
    """Byte contexts run across words, none is dropped, and word order counts."""
    rng = np.random.default_rng(3)
    some = ["red", "fox", "a", "I", "umbrellas", "Übermut", "sitting", "understanding"]
    rows = [(k, " ".join(rng.permutation(some)[: rng.integers(0, 8)])) for k in range(80)]
    rows += [(k, "qqz " + " ".join(rng.permutation(some)) + " understated sitter") for k in range(80, 140) if not zlib.crc32(str(k).encode()) % 10]
    count, longer = {}, {}
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 10:
            for chain, byte in stream_events(t):
                for j, c in enumerate(chain):
                    count.setdefault(c, Counter())[byte] += 1
                    longer.setdefault((c, byte), set()).add(chain[j - 1] if j else None)

    def log(chain, byte):
        total, child = 0.0, None
        for c in chain:
            if c not in count:
                continue
            seen = count[c]
            if child is None:
                weight, n = {b: x - 0.5 for b, x in seen.items()}, sum(seen.values())
                escape = len(seen) / 2
            else:
                weight = {b: len(longer[c, b]) - 0.5 for b in seen if b not in child}
                n = sum(len(longer[c, b]) for b in seen if b not in child)
                escape = len(weight) / 2
            if byte in weight:
                return total + math.log10(weight[byte] / n)
            total += math.log10(escape / n) if n else 0.0
            child = seen
        return total - math.log10(256 - len(count.get(b"", ())))

    got = {r["doc_id"]: r["score"] for r in ppm.score(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        assert got[k] == pytest.approx(sum(log(*e) for e in stream_events(t)), abs=1e-6)


def test_repeats_against_brute_force():
    rng = np.random.default_rng(4)
    words = textops.mix(rng.integers(0, 4, 300).astype(np.uint64))
    bounds = np.array([0, 0, 100, 101, 300])
    place, bucket, part = ppm.repeats(words, bounds)
    got = {int(p): (int(b), float(s)) for p, b, s in zip(place, bucket, part, strict=True)}
    want = {}
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        seen = {}
        for i in range(a + 2, b):
            after = seen.setdefault((words[i - 2], words[i - 1]), Counter())
            times, kinds = sum(after.values()), len(after)
            if times:
                variety = 0 if kinds == 1 else 3 if kinds == times else 1 if 2 * kinds <= times else 2
                want[int(i)] = (min(int(math.log2(times)), ppm.SIZES - 1) * ppm.FOLLOWERS + variety, after[words[i]] / times)
            after[words[i]] += 1
    assert got == want


def test_words():
    import pyarrow as pa

    texts = ["A b\x0bc", None, "", " x ", "ÄB äb ab AB"]
    data, offsets = textops.text_buffers(pa.array(texts))
    hashes, bounds = textops.hash_words(data, offsets)
    assert np.diff(bounds).tolist() == [3, 0, 0, 1, 4]
    assert hashes[6] == hashes[7] and hashes[4] != hashes[5]
    long = [f"{k} word " * 9 + "x" * (k % 3000) for k in range(3000)]
    data, offsets = textops.text_buffers(pa.array([" ".join(long)]))
    apart, cuts = textops.text_buffers(pa.array(long))
    whole = textops.find_words(data, offsets, stem=5)
    parts = [textops.find_words(apart, cuts[i : i + 2], stem=5) for i in range(len(long))]
    assert len(data) > 2 * textops.CHUNK
    assert (whole[0] == np.concatenate([p[0] for p in parts])).all() and (whole[4] == np.concatenate([p[4] for p in parts])).all()
    assert (whole[3] - whole[2] == np.concatenate([p[3] - p[2] for p in parts])).all()
    sets = list(textops.shingle_sets(hashes, bounds, 4))
    assert [len(s) for s in sets] == [1, 0, 0, 1, 1]


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs_
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs_.columns
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    messy = spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "mine") for i, t in [*MESSY, *((k, TEXT.format(k)) for k in (20, 21, 21)), (22, TEXT.format(20)), (None, TEXT.format(23))]],
        "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string",
    )
    kept = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == messy.columns
        assert {r["text_sha256"] for r in kept.collect()} <= {"mine"}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).count() >= kept.count()
    nothing = docs_.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0


def test_inner_events_are_not_written_beside_their_shuffle(spark, monkeypatch):
    """What is dealt by contexts lies in the shuffle's files already; a table of it would be there twice."""
    written = {}

    def noted(df, name, **options):
        written[name] = df.columns
        return materialise(df, name, **options)

    materialise = ppm.materialise
    monkeypatch.setattr(ppm, "materialise", noted)
    df = spark.createDataFrame([(i, "incomprehensible wordlengths " * 3 + str(i)) for i in range(20)], "doc_id long, text string")
    assert ppm.score(df).count() == 20
    assert written and not [name for name, columns in written.items() if {"block", "rows"} <= set(columns)]
