"""The pipeline's decisions against plain Python."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import decontaminate, packing, quality, queries
from tagloom.llm.tokenise import Encoder, read_file


def edits_inside(item, text):
    """The least edits that make item a part of text."""
    row = np.zeros(len(text) + 1, int)
    places = np.array([ord(c) for c in text])
    for c in item:
        best = np.minimum(row[:-1] + (places != ord(c)), row[1:] + 1)
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, x in enumerate(best, 1):
            new[j] = min(x, new[j - 1] + 1)
        row = new
    return int(row.min())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_stages(rows, good, items):
    """Ids after each of the first four stages; rows are (id, text)."""
    out = [[r for r in rows if r in good]]
    first = {}
    for key, text in out[-1]:
        same = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        first[same] = min(first.get(same, key), key)
    out.append([r for r in out[-1] if first[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")] == r[0]])
    sets, least = {k: shingles(t) for k, t in out[-1]}, {k: k for k, _ in out[-1]}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if all(least[least[k]] == least[k] for k in least):
            break
    out.append([r for r in out[-1] if least[r[0]] == r[0]])

    def leaks(text):
        padded = f" {decontaminate.plain(text)} "
        return any(edits_inside(f" {i} ", padded) <= int(0.08 * len(i)) for i in items)

    out.append([r for r in out[-1] if not leaks(r[1])])
    return [sorted(k for k, _ in stage) for stage in out]


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abdeiklmnorstu", k=rng.randint(2, 8))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    junk = lambda: " ".join("".join(rng.choices("0123456789#$%&xq", k=9)) for _ in range(25))
    items = [decontaminate.plain(prose(9)) for _ in range(3)]
    rows = [prose(40) for _ in range(30)] + [junk() for _ in range(25)]
    rows += [rows[0].replace(" ", "\n\t", 3), rows[1], rows[1], rows[2] + " one more", "start " + rows[2] + " one more", rows[3].replace(".", " but then not at all alike any more " + prose(20))]
    rows += [prose(10) + items[0].upper() + "! " + prose(10), prose(10) + " " + items[1][:20] + "q" + items[1][20:] + " " + prose(10), prose(5) + " " + items[2][:25] + " " + prose(5)]
    rows += ["", None, "two words"]
    return list(enumerate(rows)), items


def test_pipeline_against_plain_python(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(not 30 <= k < 55), 0) for k in range(55)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    judged = {r["doc_id"]: r["predicted"] for r in quality.score(documents, quality.train(documents, labels)).collect()}
    good = [r for r in rows if judged[r[0]] == 1]
    assert 30 < len(good) < len(rows)
    want = plain_stages(rows, good, items)
    kept = documents
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=False):
        kept = stage(spark, kept, str(tmp_path))
        assert sorted(r["doc_id"] for r in kept.collect()) == ids
    assert len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 20
    encoder, texts = Encoder(read_file(queries.tokenizer_path("words"))), dict(rows)
    pieces, room = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert sorted(pieces) == want[3] and max(room.values()) <= packing.CAPACITY
    for key, parts in pieces.items():
        size, at = len(encoder.ids(texts[key])) + 1, 0
        for start, length, tokens in sorted(parts):
            assert start == at and tokens == size
            at += length
        assert at == size


def test_every_stage_first_has_heaps_given_back(spark, monkeypatch):
    class Asked(Exception):
        pass

    def ask(_):
        raise Asked

    monkeypatch.setattr(corpus_pipeline, "give_back_heaps", ask)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Asked):
            stage(spark, None, "")
