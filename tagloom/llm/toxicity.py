"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary text each have an interpolated Kneser-Ney model: word bigrams back off to
words, words to their stems (first five bytes), each by continuation counts (in how many
different contexts it occurs in that kind of text), and stems to one distribution of
continuation counts that both kinds share. So an expression that is rare in either kind
costs the same in both, and a new form of a known stem counts as its stem does. The
difference of the log-likelihoods, per word and per square root of words, that of the three most
toxic words and how many words are clearly toxic become a probability by a logistic calibration
on texts that the models have not seen.

The models are fitted on a bounded sample of labelled texts (labelled.sample: at most 3,000
rows and 12 MiB for each label, two thirds for the models, one for the calibration). Words are
64-bit hashes of runs of letters, digits and non-ASCII bytes, with A-Z as a-z.

Defined cases. Null text is empty; an empty text is scored by the calibration of no
evidence. Without labelled rows of both kinds every score is the share of label 1 (0.5
without any label). Null ids are never learnt from nor held out. Repeated rows are
scored each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textops
from tagloom.llm.labelled import Calibration, held_out, sample
from tagloom.llm.store import small_batches, tidy

CUTOFF, FOLDS, DISCOUNT, STEM, TOP = 0.5, 5, 0.75, 5, 3
_START = np.uint64(0x5741525453)


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of words, hashes of their stems, and document bounds, in chunks of documents."""
    data, offsets = textops.text_buffers(texts)
    for a, b in textops.chunks(offsets):
        words, bounds, _, _, stems = textops.find_words(data, offsets[a : b + 1], textops.LETTERS, STEM)
        yield words, stems, bounds


def _bigrams(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, bigram) hashes of every word; the first of a document follows the start."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[firsts] = _START
    return before, textops.mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _counts(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """How often each of the sorted keys is found; what is not a key counts nowhere."""
    at, there = _find(keys, found)
    return np.bincount(at[there], minlength=len(keys)).astype(float)


def _discounts(times: np.ndarray) -> np.ndarray:
    """What is taken off a bigram seen 0, 1, 2, and 3 times or more, estimated from how many
    bigrams are seen so often: where nearly all are seen once, one more costs them nearly all."""
    n = [max(1, int((times == k).sum())) for k in range(1, 5)]
    part = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * part * n[k] / n[k - 1], 0.05), k - 0.01) for k in (1, 2, 3))])


class Models:
    """Both models as sorted arrays with the terms of P(word | history) of each kind."""

    def __init__(self, texts: dict[int, list[str]]):
        kinds = []
        for y in (0, 1):
            parts = [(w, s, *_bigrams(w, bounds)) for w, s, bounds in _words(pa.array(texts[y], pa.string()))]
            words, stems, histories, pairs = (np.concatenate(x) if parts else np.empty(0, np.uint64) for x in (zip(*parts, strict=True) if parts else [[]] * 4))
            distinct, first, times = np.unique(pairs, return_index=True, return_counts=True)
            kinds.append((words[first], stems[first], histories[first], distinct, times))
        self.words, first = np.unique(np.concatenate([k[0] for k in kinds]), return_index=True)
        stem_of = np.concatenate([k[1] for k in kinds])[first]
        self.stems = np.unique(stem_of)
        self.histories = np.unique(np.concatenate([k[2] for k in kinds]))
        self.pairs = np.unique(np.concatenate([k[3] for k in kinds]))
        shared = sum(_counts(self.stems, k[1]) for k in kinds)
        self.unseen = 1 / (shared.sum() + len(self.stems) + 1)
        shared = (shared + 1) * self.unseen
        at = np.searchsorted(self.stems, stem_of)
        in_word = sum(_counts(self.words, k[0]) for k in kinds)
        in_stem = np.bincount(at, weights=in_word, minlength=len(self.stems))
        of_stem = in_word / (in_stem[at] + 1)
        self.novel = (1 / (in_stem + 1)).astype(np.float32)
        self.word_p, self.stem_p, self.pair_p, self.history_rest, self.word_rest, self.stem_rest = [], [], [], [], [], []
        for words, stems, histories, pairs, times in kinds:
            every = max(1, len(pairs))
            own = _counts(self.stems, stems)
            rest = DISCOUNT * (own > 0).sum() / every if len(pairs) else 1.0
            stem_p = np.maximum(own - DISCOUNT, 0) / every + rest * shared
            self.stem_rest.append(rest)
            own = _counts(self.words, words)
            rest = DISCOUNT * (own > 0).sum() / every if len(pairs) else 1.0
            self.word_rest.append(rest)
            self.stem_p.append(stem_p.astype(np.float32))
            self.word_p.append((np.maximum(own - DISCOUNT, 0) / every + rest * stem_p[at] * of_stem).astype(np.float32))
            total = np.bincount(np.searchsorted(self.histories, histories), weights=times, minlength=len(self.histories))
            h = np.searchsorted(self.histories, histories)
            p = (times - _discounts(times)[np.minimum(times, 3)]) / total[h]
            held = np.zeros(len(self.pairs))
            held[np.searchsorted(self.pairs, pairs)] = p
            self.pair_p.append(held.astype(np.float32))
            self.history_rest.append((1 - np.bincount(h, weights=p, minlength=len(self.histories))).astype(np.float32))

    def evidence(self, words: np.ndarray, stems: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | history, toxic) - log P(word | history, ordinary) of every word, and the same
        of the backoff models alone, without the history."""
        before, pairs = _bigrams(words, bounds)
        w, known = _find(self.words, words)
        s, akin = _find(self.stems, stems)
        h, met = _find(self.histories, before)
        g, joint = _find(self.pairs, pairs)
        pick = lambda table, at, there, other: np.where(there, table[at], other) if len(table) else np.full(len(at), other)
        new = pick(self.novel, s, akin, 1.0)
        out = []
        for y in (0, 1):
            p = pick(self.stem_p[y], s, akin, self.stem_rest[y] * self.unseen) * new * self.word_rest[y]
            p = np.where(known, self.word_p[y][w], p) if len(self.words) else p
            out.append(np.log(np.maximum(p, 1e-30)))
            p = p * pick(self.history_rest[y], h, met, 1.0) + pick(self.pair_p[y], g, joint, 0.0)
            out.append(np.log(np.maximum(p, 1e-30)))
        return out[3] - out[1], out[2] - out[0]

    def features(self, texts: pa.Array) -> np.ndarray:
        rows = []
        for words, stems, bounds in _words(texts):
            whole, x = self.evidence(words, stems, bounds)
            n = np.diff(bounds)
            sums = lambda v, b=bounds: np.diff(np.concatenate(([0.0], np.cumsum(v)))[b])
            m, total = np.maximum(n, 1), sums(whole)
            hot = np.flatnonzero(x > 1)
            doc = np.searchsorted(bounds, hot, "right") - 1
            hot = hot[np.lexsort((-x[hot], doc))]
            first, held = np.searchsorted(doc, np.arange(len(n))), np.bincount(doc, minlength=len(n))
            most = np.zeros((len(n), TOP))
            for k in range(TOP):
                ok = held > k
                most[ok, k] = x[hot[first[ok] + k]]
            clear, strong = sums(x > 3), sums(x > 4.5)
            rows.append(np.column_stack([total / m, total / np.sqrt(m), most, np.log1p(clear), np.log1p(strong), np.log1p(100 * clear / m), np.log(m)]))
        return np.concatenate(rows) if rows else np.zeros((0, TOP + 6))


class Model:
    def __init__(self, texts: dict[int, list[str]], counts: dict[int, int]):
        total = counts[0] + counts[1]
        self.share = counts[1] / total if total else 0.5
        self.calibration = None
        if min(len(texts[0]), len(texts[1])) < 2:
            return
        self.models = Models({y: [t for i, t in enumerate(v) if i % 3] for y, v in texts.items()})
        rest = {y: v[::3] for y, v in texts.items()}
        y = np.concatenate([np.full(len(rest[k]), k, float) for k in (0, 1)])
        weight = np.where(y == 1, counts[1] / len(rest[1]), counts[0] / len(rest[0]))
        self.calibration = Calibration(self.models.features(pa.array(rest[0] + rest[1], pa.string())), y, weight / weight.mean())


def train(df: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    return Model(*sample(df, labels, label_col, id_col=id_col, text_col=text_col, folds=FOLDS, **options))


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n = batch.num_rows
            p = own.calibration(own.models.features(batch.column(2))) if own.calibration and n else np.full(n, own.share)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= cutoff).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), FOLDS).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
