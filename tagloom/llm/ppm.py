"""Language-model scoring by prediction by partial matching, pretrained on all training texts.

Text is scored as its sequence of words (runs of bytes other than space and 0x09-0x0D, A-Z
as a-z) and one end. Two kinds of context predict, the longest first:

- Adaptive: the two words before, as far as this text has had them. The word that follows has
  n / T of what does not escape if it followed n of T times. The escape is estimated over all
  training texts, for each size of T and number of different followers. These symbols are whole
  words; the bytes below them are another alphabet, in which no word is excluded.
- Pretrained: byte contexts. A word's first ``CROSS`` - 1 bytes have the ``CROSS`` bytes before them, which
  reach across the space into the words before; the others have all bytes since that space.
  Shorter contexts are the last six of these bytes to none. A text's first word comes after a
  space and line feeds. In a context with T occurrences of q different bytes, a byte seen c times
  has (c - 1/2) / T and an escape q / 2T (method D). After an escape the next shorter context
  predicts with the bytes of the longer one excluded, and counts every context one byte longer
  once, as what follows an escape is new. Below the empty context every byte that it has not seen
  is as likely as another. A word ends with a space, a text with a line feed.

From its byte ``CROSS`` on a word's contexts lie inside it, so the code length of the rest of
a word is computed once for the corpus. The bytes before it are windows of a byte and the ``CROSS``
before it, counted and looked up over the texts' bytes:

1. One scan counts the words of all texts (training texts with weight one, others with
   none), summed up for each task and then for each part of the hash range, in the same
   way the windows, and how often adaptive contexts escape.
2. Windows and the inner events of distinct words (a byte and its contexts) are dealt by the last
   three bytes before them, so a part has every longer context with these bytes and, with the
   contexts of two bytes, one and none, which are broadcast (at most 2**24 entries of a byte after
   two, of which valid UTF-8 text has fewer), the whole chain of escapes. No context is left out.
   Each part predicts its events and returns the sums to the words.
3. Each part sums up its distinct words. The most frequent words, at most
   ``MAX_FREQUENT``, are broadcast with count and code length, and so are the most frequent
   windows, at most ``MAX_WINDOWS``.
4. A second scan sums up each text's frequent words and windows and passes the others, by
   hash, to the parts, which return their sums.

What is gathered grows with the corpus and stays distributed, in parts whose number grows with
the texts' bytes; only the short contexts and the frequent words and windows, of bounded size,
reach the driver.

Defined cases. Null text is empty: its end only. Null ids are scored and train the model
(they have no remainder to hold them out). Repeated rows are counted and scored each. Other
columns are ignored. With no training text every byte has 1/256. An empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textops
from tagloom.llm.labelled import held_out
from tagloom.llm.store import discard, finished, materialise, small_batches, tidy

FOLDS, ORDER, CROSS = 10, 6, 6
PART_BYTES, PART_POWER = 1 << 22, 0.75
MAX_FREQUENT, MAX_WINDOWS = 1 << 19, 1 << 21
SMOOTH = 0.1
END = np.uint64(0x0A0A0A0A0A0A0A0A)
FLUSH, AT_ONCE = 200_000, 100_000
WHOLE = 7
BLOCK_BITS = 12
SIZES, FOLLOWERS = 8, 4
_STEP, _BYTE = np.uint64(8), np.uint64(255)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)] if total else np.empty(0, np.uint8)


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The stable order of evenly spread keys: their leading bits and their places, sorted at once."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length())) if len(keys) else np.uint64(1)
    mixed = keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    order = (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ranked = keys[order]
    alike = mixed[1:] >> bits == mixed[:-1] >> bits
    if (ranked[1:][alike] != ranked[:-1][alike]).any():
        return np.argsort(keys, kind="stable")
    return order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, first place of each, which of them each key is) of evenly spread keys."""
    order = _ranked(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return ranked[fresh], order[fresh], back


class Words:
    """Distinct words: hashes, counts, sizes and bytes."""

    def __init__(self, hashes, counts, sizes, data):
        self.hashes, self.counts, self.sizes, self.data = hashes, counts, sizes, data

    @staticmethod
    def join(parts: list[Words]) -> Words:
        if len(parts) == 1 and len(parts[0].hashes) < 2:
            return parts[0]
        hashes, counts, sizes, data = (np.concatenate([getattr(p, k) for p in parts]) for k in ("hashes", "counts", "sizes", "data"))
        keys, first, back = _distinct(hashes)
        starts = np.cumsum(sizes) - sizes
        return Words(keys, np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64), sizes[first], _gather(data, starts[first], sizes[first]))

    def pick(self, where: np.ndarray) -> Words:
        starts = np.cumsum(self.sizes) - self.sizes
        return Words(self.hashes[where], self.counts[where], self.sizes[where], _gather(self.data, starts[where], self.sizes[where]))

    def blobs(self) -> list[bytes]:
        return [self.hashes.tobytes(), self.counts.tobytes(), self.sizes.astype("<i4").tobytes(), self.data.tobytes()]

    @staticmethod
    def of(hashes: bytes, counts: bytes, sizes: bytes, data: bytes) -> Words:
        return Words(np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(data, np.uint8))


WORDS = "part int, hashes binary, counts binary, sizes binary, data binary"
TALLY = "tally array<long>"


def _word_rows(words: Words, part: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    cuts = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
    rows = [(int(part[c[0]]), *words.pick(c).blobs()) for c in cuts if len(c)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(zip(*rows, strict=True))], ["part", "hashes", "counts", "sizes", "data"])


def _with_ends(hashes: np.ndarray, bounds: np.ndarray, end=END) -> tuple[np.ndarray, np.ndarray]:
    """The words with the end of each text as one more word after them."""
    return np.insert(hashes, bounds[1:], end), bounds + np.arange(len(bounds))


def crossings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, word) of the bytes of every word, with the space after it, whose contexts reach
    across the space before it, and of the ends of texts, each of which is one more word: the byte,
    lowest, and above it the bytes before it. Before a text's first space there are line feeds,
    as beyond the contexts' reach."""
    own = ends - starts
    sizes, bounds = _with_ends(own, bounds, 1)
    real = np.ones(len(sizes), bool)
    real[bounds[1:] - 1] = False
    lead = np.zeros(len(sizes), np.int64)
    lead[bounds[:-1]] = CROSS
    stops = np.cumsum(sizes + 1 + lead)
    begins = stops - sizes - 1
    text = np.full(int(stops[-1]) if len(stops) else 0, 10, np.uint8)
    text[begins] = 32
    text[np.repeat(begins[real] + 1 - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))] = textops._FOLD[_gather(data, starts, own)]
    owners = [np.flatnonzero(sizes + real >= d) for d in range(1, CROSS)]
    places = np.concatenate([begins[w] + d for d, w in enumerate(owners, 1)])
    window = np.full(len(places), sum(10 << 8 * j for j in range(CROSS + 1, ORDER + 1)), np.uint64)
    for j in range(CROSS + 1):
        window |= text[places - j].astype(np.uint64) << np.uint64(8 * j)
    return window, np.concatenate(owners)


def _merged(held: list[np.ndarray]) -> list[np.ndarray]:
    """The windows of all tables as one sorted table, weights summed."""
    every = np.concatenate(held)
    order = np.argsort(every["window"])
    window = every["window"][order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(window)), bool), window[1:] != window[:-1])))
    rows = np.empty(len(first), WINDOW)
    rows["window"] = window[first]
    rows["weight"] = np.add.reduceat(every["weight"][order], first) if len(first) else 0
    return [rows]


def _counted(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of distinct words with their counts in a task's training texts, rows of windows with
    theirs, and a last row of
    how often adaptive contexts of each bucket had the next word and how often not."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Words] = []
        size = 0
        tally = np.zeros((2, SIZES * FOLLOWERS), np.int64)
        windows: list[np.ndarray] = []

        def flush():
            words = Words.join(held)
            rows = _word_rows(words, (words.hashes % np.uint64(parts)).astype(np.int32))
            return rows.append_column("tally", pa.nulls(rows.num_rows, pa.list_(pa.int64()))).append_column("windows", pa.nulls(rows.num_rows, pa.binary()))

        def flush_windows(rows: np.ndarray) -> pa.RecordBatch:
            part, blobs = _dealt(rows, _suffix(rows["window"], parts))
            none = pa.nulls(len(part), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), none, none, none, none, pa.nulls(len(part), pa.list_(pa.int64())), pa.array(blobs, pa.binary())], ["part", "hashes", "counts", "sizes", "data", "tally", "windows"])

        for batch in batches:
            learn = ~np.array(batch.column(0).to_pylist(), bool)
            data, offsets = textops.text_buffers(batch.column(1))
            for a, b in textops.chunks(offsets):
                cut = offsets[a : b + 1]
                hashes, bounds, starts, ends, _ = textops.find_words(data, cut)
                weight = np.repeat(learn[a:b], np.diff(bounds)).astype(float)
                keys, first, back = _distinct(hashes)
                sizes = (ends - starts)[first]
                text = textops._FOLD[_gather(data, starts[first] + int(cut[0]), sizes)]
                counts = np.bincount(back, weights=weight, minlength=len(keys)).astype(np.int64)
                ending = Words(np.array([END]), np.array([learn[a:b].sum()], np.int64), np.array([1]), np.array([10], np.uint8))
                held += [Words(keys, counts, sizes, text), ending]
                size += len(keys)
                window, owner = crossings(data[int(cut[0]) : int(cut[-1])], starts, ends, bounds)
                teaches = np.repeat(learn[a:b], np.diff(bounds) + 1)[owner]
                for some, weight in ((window[teaches], 1), (window[~teaches], 0)):
                    found, times = np.unique(some, return_counts=True)
                    rows = np.empty(len(found), WINDOW)
                    rows["window"], rows["weight"] = found, times * weight
                    windows.append(rows)
                place, bucket, share = repeats(*_with_ends(hashes, bounds))
                taught = learn[a + np.searchsorted(bounds + np.arange(len(bounds)), place, "right") - 1]
                tally += [np.bincount(bucket[taught & ok], minlength=SIZES * FOLLOWERS) for ok in (share > 0, share == 0)]
            if size > 2 * FLUSH:
                held = [Words.join(held)]
                size = len(held[0].hashes)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
            if sum(map(len, windows)) > 4 * FLUSH:
                windows = _merged(windows)
                if len(windows[0]) > 2 * FLUSH:
                    yield flush_windows(windows[0])
                    windows = []
        if windows:
            yield flush_windows(_merged(windows)[0])
        if held:
            yield flush()
            none = [None]
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int32()), *(pa.array(none, pa.binary()) for _ in range(4)), pa.array([tally.reshape(-1)], pa.list_(pa.int64())), pa.array(none, pa.binary())], ["part", "hashes", "counts", "sizes", "data", "tally", "windows"])

    return docs.select("held_out", "text").mapInArrow(tidy(count), f"{WORDS}, {TALLY}, windows binary")


def _vocabulary(counted: DataFrame, parts: int) -> DataFrame:
    """Blocks of up to 65,536 distinct words with their counts in all training texts, numbered
    within their part."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Words.of(*row) for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)]
        if held:
            words = Words.join(held)
            for i in range(0, len(words.hashes), 1 << 16):
                some = words.pick(np.arange(i, min(i + (1 << 16), len(words.hashes))))
                made = _word_rows(some, np.full(len(some.hashes), int(some.hashes[0] % np.uint64(parts)), np.int32))
                yield made.append_column("block", pa.array([i >> 16], pa.int32()))

    # every word of a row has the same part, so rows of one part meet; parts that share a task are kept apart
    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                rows.setdefault(part, []).append(batch.slice(i, 1))
        for part in sorted(rows):
            yield from merge(iter(rows.pop(part)))

    return counted.where("hashes is not null").drop("tally", "windows").repartitionById(parts, F.col("part")).mapInArrow(tidy(by_part), f"{WORDS}, block int")


def events(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, place of each predicted byte, its distance from the space before the
    word, its word). A word is followed by a space; the end of text is a line feed alone."""
    ends_text = words.hashes == END
    sizes = words.sizes + 1 + ~ends_text
    stops = np.cumsum(sizes)
    begins = stops - sizes
    padded = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
    inside = np.repeat(begins + 1 - (np.cumsum(words.sizes) - words.sizes), words.sizes) + np.arange(int(words.sizes.sum()))
    padded[inside] = words.data
    places = np.repeat(begins + 1 - (np.cumsum(sizes - 1) - (sizes - 1)), sizes - 1) + np.arange(int((sizes - 1).sum()))
    owner = np.repeat(np.arange(len(sizes)), sizes - 1)
    return padded, places, places - begins[owner], owner


def _contexts(padded: np.ndarray, places: np.ndarray, depth: np.ndarray, order: int) -> np.ndarray:
    """Context keys: the order above 48 bits, and below them the bytes before each place, or,
    for the order WHOLE, a hash of all bytes since the space before the word."""
    if order == WHOLE:
        spread = textops.mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[padded]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * textops._power(textops._BASE, len(padded)))))
        return np.uint64(WHOLE << 48) | textops.hash_span(total, places - depth, places) >> np.uint64(16)
    key = np.full(len(places), order << 48, np.uint64)
    for j in range(1, order + 1):
        key |= padded[places - j].astype(np.uint64) << np.uint64(8 * (j - 1))
    return key


def _reaches(depth: np.ndarray, order: int) -> np.ndarray:
    """Whether a context of this order exists at this distance from the word's start."""
    return depth > ORDER if order == WHOLE else depth >= order


def repeats(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bucket, share) of the words whose two words before occurred in the same text
    before: bucket by how often and with how many different followers; share is the part of
    those times that this word followed."""
    place = np.arange(len(words))
    inside = place - np.repeat(bounds[:-1], np.diff(bounds)) >= 2
    place = place[inside]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[inside].astype(np.uint64)
    before = textops.mix(textops.mix(words[place - 2] + text) * np.uint64(textops._BASE) + words[place - 1])
    order = _ranked(before)
    ranked = before[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    twice = ~fresh
    twice[:-1] |= ~fresh[1:]
    order, fresh = order[twice], fresh[twice]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    times = np.arange(len(order)) - first[group]
    follows = textops.mix(group.astype(np.uint64) * np.uint64(textops._BASE) + words[place[order]])
    by = _ranked(follows)
    new = np.concatenate(([True], follows[by][1:] != follows[by][:-1]))
    run = np.cumsum(new) - 1
    had = np.empty(len(order), np.int64)
    had[by] = np.arange(len(order)) - np.flatnonzero(new)[run]
    kinds = np.cumsum(had == 0) - (had == 0)
    kinds -= kinds[first][group]
    ok = times > 0
    times, kinds, had = times[ok], kinds[ok], had[ok]
    size = np.minimum(np.log2(times).astype(np.int64), SIZES - 1)
    variety = np.where(kinds == 1, 0, np.where(kinds == times, 3, np.where(2 * kinds <= times, 1, 2)))
    return place[order[ok]], size * FOLLOWERS + variety, had / times


#: An event: the byte and the six before it (the byte lowest), the context WHOLE or zero, its
#: weight, and which word of its block asks for it.
EVENT = np.dtype([("window", "<u8"), ("whole", "<u8"), ("weight", "<i8"), ("word", "<u4")])
WINDOW = np.dtype([("window", "<u8"), ("weight", "<i8")])
TERM = np.dtype([("word", "<u4"), ("log", "<f8")])


def _pack_column(column: np.ndarray, steps: bool = False) -> bytes:
    """A column byte by byte, as differences if it comes mostly sorted. Compressed here, since Parquet's
    codec takes memory outside the heap for whole pages."""
    column = np.ascontiguousarray(np.diff(column, prepend=column.dtype.type(0)) if steps else column)
    planes = np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T)
    return len(column).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack_column(blob: bytes, kind: np.dtype, steps: bool = False) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n * size, asbytes=True), np.uint8).reshape(size, n)
    column = np.ascontiguousarray(planes.T).view(kind).reshape(n)
    return np.cumsum(column, dtype=kind) if steps else column


def _packed(rows: np.ndarray) -> bytes:
    """Column by column."""
    blobs = [_pack_column(rows[c], c == "window") for c in rows.dtype.names]
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    columns, at = [], 0
    for c in kind.names:
        size = int.from_bytes(blob[at : at + 8], "little")
        columns.append(_unpack_column(blob[at + 8 : at + 8 + size], kind[c], c == "window"))
        at += 8 + size
    rows = np.empty(len(columns[0]), kind)
    for c, column in zip(kind.names, columns, strict=True):
        rows[c] = column
    return rows


def _dealt(rows: np.ndarray, part: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The rows of each part that has any, packed."""
    order = np.argsort(part, kind="stable")
    cuts = [c for c in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(c)]
    return [int(part[c[0]]) for c in cuts], [_packed(rows[c]) for c in cuts]


def _suffix(window: np.ndarray, parts: int) -> np.ndarray:
    """The part that has every context of three bytes or more with the same last three bytes."""
    return (textops.mix(window >> _STEP & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int32)


def _inner_events(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """events() of distinct words, those only whose contexts lie inside the word."""
    padded, places, depth, owner = events(words)
    inner = depth >= CROSS
    return padded, places[inner], depth[inner], owner[inner]


def _word_events(words: Words) -> np.ndarray:
    """The events of distinct words whose contexts lie inside the word; line feeds stand for what
    is before it."""
    padded, places, depth, owner = _inner_events(words)
    window = padded[places].astype(np.uint64)
    for j in range(1, ORDER + 1):
        window |= np.where(depth >= j, padded[places - j], 10).astype(np.uint64) << np.uint64(8 * j)
    rows = np.zeros(len(places), EVENT)
    rows["window"], rows["weight"], rows["word"] = window, words.counts[owner], owner
    far = np.flatnonzero(_reaches(depth, WHOLE))
    rows["whole"][far] = _contexts(padded, places[far], depth[far], WHOLE)
    return rows


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, summed weights, how many rows each has)."""
    found, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    return found, np.bincount(back, weights=weights, minlength=len(found)), times


class Common:
    """(keys, above, weights, kinds) of the contexts of one byte and none, and of those of two."""

    def __init__(self, window: np.ndarray, n: np.ndarray, kinds: np.ndarray):
        self.before = (window >> _STEP).astype(np.uint16)
        self.two = (np.uint64(2 << 56) | window, np.uint64(1 << 48) | (window & np.uint64(0xFFFF)) >> _STEP, n, kinds)
        pairs, total, different = _grouped(window & np.uint64(0xFFFF), n)
        last, every, after = _grouped(pairs & _BYTE, total)
        none = np.zeros(len(pairs) + len(last), np.uint64)
        self.short = (np.concatenate((np.uint64(1 << 56) | pairs, last)), none, np.concatenate((total, every)), np.concatenate((different, after)))

    def beside(self, window: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """The short contexts and, of those of two bytes, the ones that these events come after."""
        asked = np.zeros(1 << 16, bool)
        asked[(window >> _STEP).astype(np.uint16)] = True
        some = asked[self.before]
        return [tuple(column[some] for column in self.two), self.short]


def _common(vocabulary: DataFrame, windows: DataFrame) -> Common:
    """The contexts that every part needs, from the last four bytes of the words' inner events and of windows.
    The events are made for this alone, since a table of them would lie beside the shuffle that deals them."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.uint64), np.empty(0))
        waiting, size = [held], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _grouped(np.concatenate([w for w, _ in waiting]), np.concatenate([n for _, n in waiting]))[:2]

        for batch in batches:
            for blob, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if blob is None:
                    words = Words.of(*row)
                    padded, places, _, owner = _inner_events(words)
                    last, weight = sum(padded[places - j].astype(np.uint64) << np.uint64(8 * j) for j in range(4)), words.counts[owner]
                else:
                    rows = _unpacked(blob, WINDOW)
                    last, weight = rows["window"] & np.uint64(0xFFFFFFFF), rows["weight"]
                taught = weight > 0
                waiting.append(_grouped(last[taught], weight[taught])[:2])
                size += len(waiting[-1][0])
                if size > 4 * FLUSH:
                    waiting = [merged()]
                    size = 0
        window, n = merged()
        for i in range(0, len(window), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(window[i : i + (1 << 16)].astype(np.int64)), pa.array(n[i : i + (1 << 16)].astype(np.int64))], ["window", "n"])

    none = F.lit(None).cast("binary")
    words = ("hashes", "counts", "sizes", "data")
    both = vocabulary.select(none.alias("windows"), *words).unionByName(windows.select("windows", *(none.alias(c) for c in words)))
    four = both.mapInArrow(tidy(short), "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))
    three = four.groupBy(F.expr("window & 16777215").alias("window")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    window, n, kinds = (three[c].to_numpy() for c in ("window", "n", "kinds"))
    return Common(window.astype(np.uint64), n, kinds)


def _part_trie(window: np.ndarray, whole: np.ndarray, weight: np.ndarray, common: Common) -> Trie:
    """The trie of all training events with some three last bytes of their contexts, and of the
    common contexts. An entry's kinds are the contexts one longer that have it."""
    beside = common.beside(window)
    ok = weight > 0
    window, whole, weight = window[ok], whole[ok], weight[ok]
    long = whole > 0
    own, first, back = np.unique(whole[long] << _STEP | window[long] & _BYTE, return_index=True, return_inverse=True)
    under = window[long][first]
    found = [(own, np.uint64(ORDER << 48) | under >> _STEP, np.bincount(back, weights=weight[long], minlength=len(own)), np.ones(len(own)))]
    direct, times, _ = _grouped(window[~long], weight[~long])
    under, n = np.concatenate((under, direct)), np.concatenate((found[0][2], times))
    for order in range(ORDER, 2, -1):
        under, n, kinds = _grouped(under & np.uint64((1 << 8 * (order + 1)) - 1), n)
        found.append((np.uint64(order << 56) | under, np.uint64((order - 1) << 48) | (under & np.uint64((1 << 8 * order) - 1)) >> _STEP, n, kinds))
    return Trie(*(np.concatenate(x) for x in zip(*found, *beside, strict=True)))


class Trie:
    """The model: contexts and the bytes that follow them, with every log10 probability resolved."""

    def __init__(self, keys: np.ndarray, above: np.ndarray, weights: np.ndarray, kinds: np.ndarray):
        order = np.argsort(keys)
        self.keys, above, c, k = keys[order], above[order], weights[order].astype(float), kinds[order].astype(float)
        self.nodes, first, node, q = np.unique(self.keys >> _STEP, return_index=True, return_inverse=True, return_counts=True)
        total, different = (np.bincount(node, weights=v, minlength=len(self.nodes)) for v in (c, k))
        has = self.nodes >> np.uint64(48) > 0
        self.parent = np.where(has, np.searchsorted(self.nodes, above[first]), -1)
        up = self.parent[node]
        inner = up >= 0
        at = np.searchsorted(self.keys, self.nodes[up[inner]] << _STEP | self.keys[inner] & _BYTE)
        excluded = np.bincount(node[inner], weights=k[at], minlength=len(self.nodes))
        left = np.where(has, different[self.parent] - excluded, 0.0) if len(self.nodes) else np.zeros(0)
        fresh = np.where(has, q[self.parent] - q, 0) if len(self.nodes) else np.zeros(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.direct = np.log10((c - 0.5) / total[node])
            self.escape = np.log10(q / 2 / total)
            self.escape_after = np.where(left > 0, np.log10(fresh / 2 / left), 0.0)
            self.log_left = np.where(left > 0, np.log10(left), 0.0)
        self.half = np.log10(k - 0.5)
        self.unknown = -np.log10(256 - (q[0] if len(self.nodes) and not has[0] else 0))

    def score(self, words: Words) -> np.ndarray:
        """log10 probability of each word, with the space or line feed that ends it."""
        padded, places, depth, owner = events(words)
        symbol = padded[places].astype(np.uint64)
        node = np.full(len(places), -1)
        if len(self.nodes):
            for order in range(WHOLE, -1, -1):
                ask = np.flatnonzero((node < 0) & _reaches(depth, order))
                keys = _contexts(padded, places[ask], depth[ask], order)
                at = np.minimum(np.searchsorted(self.nodes, keys), len(self.nodes) - 1)
                hit = self.nodes[at] == keys
                node[ask[hit]] = at[hit]
        return np.bincount(owner, weights=self.walk(node, symbol), minlength=len(words.hashes))

    def of_events(self, window: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """log10 probability of each event."""
        node = np.full(len(window), -1)
        for order in range(WHOLE, -1, -1):
            ask = np.flatnonzero((node < 0) & (whole > 0) if order == WHOLE else node < 0)
            if not len(ask) or not len(self.nodes):
                continue
            keys = whole[ask] if order == WHOLE else np.uint64(order << 48) | (window[ask] & np.uint64((1 << 8 * (order + 1)) - 1)) >> _STEP
            at = np.minimum(np.searchsorted(self.nodes, keys), len(self.nodes) - 1)
            hit = self.nodes[at] == keys
            node[ask[hit]] = at[hit]
        return self.walk(node, window & _BYTE)

    def walk(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after the context of its node, or after none (-1)."""
        out = np.zeros(len(node))
        node = node.copy()
        live = np.flatnonzero(node >= 0)
        out[node < 0] = self.unknown
        via = np.full(len(node), -1)
        while len(live):
            keys = self.nodes[node[live]] << _STEP | symbol[live]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            came = via[live]
            done, entry, child = live[hit], at[hit], came[hit]
            out[done] += np.where(child < 0, self.direct[entry], self.half[entry] - self.log_left[child])
            rest, child = live[~hit], came[~hit]
            out[rest] += np.where(child < 0, self.escape[node[rest]], self.escape_after[child])
            via[rest] = node[rest]
            node[rest] = self.parent[node[rest]]
            out[rest[node[rest] < 0]] += self.unknown
            live = rest[node[rest] >= 0]
        return out


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)) * 16, 1023).astype(int)


def _answers(vocabulary: DataFrame, windows: DataFrame, parts: int) -> DataFrame:
    """(part, block, terms, hashes, weights, logs, often): log10 probabilities of the inner parts of
    blocks of distinct words, in terms to be summed up, and of windows, with their hashes and counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, block, *row in zip(*(batch.column(i).to_pylist() for i in (0, 5, 1, 2, 3, 4)), strict=True):
                rows = _word_events(Words.of(*row))
                part, blobs = _dealt(rows, _suffix(rows["window"], parts))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([own] * len(part), pa.int32()), pa.array([block] * len(part), pa.int32()), pa.array(blobs, pa.binary())], ["part", "own", "block", "rows"])

    inner = vocabulary.mapInArrow(tidy(ask), "part int, own int, block int, rows binary")
    none = lambda kind: F.lit(None).cast(kind)
    asked = inner.select("part", "own", "block", "rows", none("binary").alias("windows")).unionByName(windows.select("part", none("int").alias("own"), none("int").alias("block"), none("binary").alias("rows"), "windows"))
    common = vocabulary.sparkSession.sparkContext.broadcast(_common(vocabulary, windows))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    names = ["part", "block", "terms", "hashes", "weights", "logs", "often"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met, blocks = [np.empty(0, EVENT)], [np.empty(0, WINDOW)], [(0, 0)]
        waiting = 0
        for batch in batches:
            for own, block, rows, blob in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if blob is None:
                    held.append(_unpacked(rows, EVENT))
                    blocks.append((own, block))
                else:
                    met.append(_unpacked(blob, WINDOW))
                    waiting += len(met[-1])
                    if waiting > max(4 * AT_ONCE, len(met[0])):
                        met, waiting = _merged(met), 0
        ends = np.cumsum([len(x) for x in held])
        every, seen = np.concatenate(held), _merged(met)[0]
        del held, met
        if not len(every) + len(seen):
            return
        window, whole = np.concatenate((every["window"], seen["window"])), np.concatenate((every["whole"], np.zeros(len(seen), np.uint64)))
        weight, word = np.concatenate((every["weight"], seen["weight"])), every["word"].copy()
        del every
        logs = _part_logs(window, whole, weight, common.value)
        del window, whole, weight
        for (own, block), start, end in zip(blocks[1:], ends[:-1], ends[1:], strict=True):
            words, back = np.unique(word[start:end], return_inverse=True)
            sums = np.empty(len(words), TERM)
            sums["word"], sums["log"] = words, np.bincount(back, weights=logs[start:end], minlength=len(words))
            row = (own, block, _packed(sums), None, None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
        hashes, logs, weights = textops.mix(seen["window"]), logs[len(word) :], seen["weight"]
        to = (hashes % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        for c in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            if len(c):
                often = np.bincount(_bin(weights[c])[weights[c] > 0], minlength=1024).tolist()
                row = (int(to[c[0]]), None, None, hashes[c].tobytes(), weights[c].tobytes(), logs[c].tobytes(), often)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return materialise(asked.repartitionById(parts, F.col("part")).mapInArrow(tidy(answer), "part int, block int, terms binary, hashes binary, weights binary, logs binary, often array<long>"), "answers")


def _frequent(rows: DataFrame, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, logs) of the items with the largest counts, at most room, by hash."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(1024, np.int64)
        for batch in batches:
            every += batch.column(0).flatten().to_numpy().reshape(-1, 1024).sum(0)
        bins = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), pa.array(every[bins])], ["bin", "n"])

    tallied = rows.select("often").mapInArrow(tidy(tally), "bin int, n long")
    levels = tallied.groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()  # 1,024 rows
    least = 1 << 30
    for row in levels:
        room -= row["n"]
        if room < 0:
            break
        least = row["bin"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts, logs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = np.frombuffer(counts, np.int64)
                ok = (c > 0) & (_bin(c) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)[ok]), pa.array(c[ok]), pa.array(np.frombuffer(logs)[ok])], ["hash", "n", "log"])

    found = rows.select("hashes", "counts", "logs").mapInArrow(tidy(pick), "hash long, n long, log double").toArrow()  # at most room rows
    keys = found["hash"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy()[order], found["log"].to_numpy()[order]


class Table:
    """Sorted evenly spread hashes, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def look(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether it is there)."""
        slot = wanted >> self.shift
        at, stop = self.first[slot], self.first[slot + np.uint64(1)]
        hit = np.zeros(len(wanted), bool)
        live = np.flatnonzero(at < stop)
        while len(live):
            same = self.keys[at[live]] == wanted[live]
            hit[live[same]] = True
            live = live[~same]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return np.minimum(at, max(0, len(self.keys) - 1)), hit


def _part_logs(window: np.ndarray, whole: np.ndarray, weight: np.ndarray, common: Common) -> np.ndarray:
    """log10 probabilities of events, a few of the last three bytes of contexts at a time."""
    last = sum((window >> np.uint64(8 * j) & _BYTE).astype(np.uint32) << np.uint32(8 * (3 - j)) for j in (1, 2, 3))
    order = np.argsort(last, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(last[order])) + 1, len(order))
    logs = np.empty(len(window))
    a = 0
    while a < len(order):
        b = int(ends[min(np.searchsorted(ends, a + AT_ONCE), len(ends) - 1)])
        some = order[a:b]
        logs[some] = _part_trie(window[some], whole[some], weight[some], common).of_events(window[some], whole[some])
        a = b
    return logs


def score(df: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, as a written
    table. base_score is the text's log10 probability by smoothed word frequencies."""
    return finished(lambda: _score(df, **options), "scores")


def _score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    # distinct words and windows grow with a power of the text
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size / PART_BYTES) ** PART_POWER))
    counted = materialise(_counted(docs, parts), "counted")
    tallies = counted.where("tally is not null").select(F.posexplode("tally").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # 64 rows
    tally = np.zeros((2, SIZES * FOLLOWERS))
    for r in tallies:
        tally[divmod(r["i"], SIZES * FOLLOWERS)] = r["n"]
    escapes = (tally[1] + 0.5) / (tally.sum(0) + 1)
    vocabulary = materialise(_vocabulary(counted, parts), "vocabulary")
    answers = _answers(vocabulary, counted.where("windows is not null").select("part", "windows"), parts)
    discard(counted)
    terms = answers.where("terms is not null")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        found: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for part, block, hashes, counts, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if blob is None:
                    held[part, block] = hashes, counts
                else:
                    found.setdefault((part, block), []).append(blob)
        for key, (hashes, counts) in held.items():
            c = np.frombuffer(counts, np.int64)
            terms = np.concatenate([np.empty(0, TERM), *(_unpacked(blob, TERM) for blob in found.pop(key, ()))])
            log = np.bincount(terms["word"], weights=terms["log"], minlength=len(c))
            often = np.bincount(_bin(c)[c > 0], minlength=1024)
            row = (key[0], hashes, counts, log.tobytes(), int(c.sum()), int((c > 0).sum()), often.tolist())
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "hashes", "counts", "logs", "tokens", "known", "often"])

    none = F.lit(None).cast("binary")
    both = vocabulary.select("part", "block", "hashes", "counts", none.alias("terms")).unionByName(terms.select("part", "block", none.alias("hashes"), none.alias("counts"), "terms"))
    judged = materialise(both.repartitionById(parts, F.col("part")).mapInArrow(tidy(judge), "part int, hashes binary, counts binary, logs binary, tokens long, known long, often array<long>"), "words")
    discard(vocabulary)
    sums = judged.agg(F.sum("tokens").alias("n"), F.sum("known").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"] or 0
    keys, counts, logs = _frequent(judged, MAX_FREQUENT)
    windows = answers.where("hashes is not null")
    common_windows, _, window_logs = _frequent(windows.select("hashes", F.col("weights").alias("counts"), "logs", "often"), MAX_WINDOWS)
    table = spark.sparkContext.broadcast((keys, np.log10(counts + SMOOTH), logs, common_windows, window_logs))
    scan_kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary())
    scan_names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "log", "part", "hashes", "rows"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_known, bases, logs, common_windows, window_logs = table.value
        known_words, known_windows = Table(hashes_known), Table(common_windows)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = textops.text_buffers(batch.column(2))
            tokens, known, base, log, rare, owners = [], [], [], [], [], []
            for a, b in textops.chunks(offsets):
                hashes, bounds, starts, ends, _ = textops.find_words(data, offsets[a : b + 1])
                window, owner = crossings(data[int(offsets[a]) : int(offsets[b])], starts, ends, bounds)
                n = np.diff(bounds)
                hashes, bounds = _with_ends(hashes, bounds)
                place, bucket, share = repeats(hashes, bounds)
                asked = np.ones(len(hashes), bool)  # whether the trie is asked for the word
                asked[place[share > 0]] = False
                ahead = np.zeros(len(hashes))
                ahead[place] = np.log10(np.where(share > 0, (1 - escapes[bucket]) * share, escapes[bucket]))
                at, hit = known_words.look(hashes)
                some = asked[owner]
                window, owner = textops.mix(window[some]), owner[some]
                there, found = known_windows.look(window)
                if len(common_windows):
                    ahead += np.bincount(owner[found], weights=window_logs[there[found]], minlength=len(hashes))
                add = lambda v, b=bounds: np.diff(np.concatenate(([0.0], np.cumsum(v)))[b])
                tokens.append(n + 1)
                known.append(add(hit).astype(np.int64))
                base.append(add(np.where(hit, bases[at], 0.0)) if len(hashes_known) else np.zeros(len(n)))
                log.append(add(ahead + (np.where(hit & asked, logs[at], 0.0) if len(hashes_known) else 0.0)))
                text = row + a + np.repeat(np.arange(len(n)), n + 1)
                rare += [hashes[~hit], window[~found]]
                owners += [(text * 2 + asked)[~hit], text[owner[~found]] * 2 + 1]
            count = batch.num_rows
            if not count:
                continue
            none = [None] * count
            columns = (np.arange(row, row + count), batch.column(0), batch.column(1), *map(np.concatenate, (tokens, known, base, log)), none, none, none)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, scan_kinds, strict=True)], scan_names)
            row += count
            rare, owners = np.concatenate(rare), np.concatenate(owners)
            if len(rare):
                order = _ranked(rare)
                rare, owners = rare[order], owners[order]
                part = (rare % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int32)  # 16 bits are sorted by radix
                order = np.argsort(part, kind="stable")
                cuts = [c for c in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(c)]
                none = [None] * len(cuts)
                columns = (*[none] * 7, [int(part[c[0]]) for c in cuts], [_pack_column(rare[c], True) for c in cuts], [_pack_column(owners[c]) for c in cuts])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, scan_kinds, strict=True)], scan_names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double, part int, hashes binary, rows binary"
    scanned = materialise(docs.mapInArrow(tidy(scan), schema), "scan")

    kind = np.dtype([("row", "<i8"), ("known", "<f8"), ("base", "<f8"), ("log", "<f8")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []
        asked: list[tuple] = []
        for batch in batches:
            for hashes, rows, counts, logs in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if rows is None:
                    own = np.frombuffer(hashes, np.uint64)
                    known.append((own, np.full(len(own), -1) if counts is None else np.frombuffer(counts, np.int64), np.frombuffer(logs)))
                else:
                    asked.append((_unpack_column(hashes, np.uint64, True), _unpack_column(rows, np.int64)))
        if not asked:
            return
        keys, counts, logs = (np.concatenate(x) for x in zip(*known, strict=True))
        order = np.argsort(keys)
        keys, counts, logs = keys[order], counts[order], logs[order]
        hashes, rows = (np.concatenate(x) for x in zip(*asked, strict=True))
        at = np.searchsorted(keys, hashes)
        owner, back = np.unique(rows >> 1, return_inverse=True)
        sums = np.empty(len(owner), kind)
        sums["row"] = owner
        for name, values in (("known", counts[at] > 0), ("base", np.where(counts[at] < 0, 0.0, np.log10(np.maximum(counts[at], 0) + SMOOTH))), ("log", logs[at] * (rows & 1))):
            sums[name] = np.bincount(back, weights=values, minlength=len(owner))
        block = owner >> BLOCK_BITS
        cuts = np.split(sums, np.flatnonzero(np.diff(block)) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([int(c["row"][0]) >> BLOCK_BITS for c in cuts], pa.int64()), pa.array([c.tobytes() for c in cuts], pa.binary())], ["block", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(blob, kind) for batch in batches for blob in batch.column(1).to_pylist()]
        if not found:
            return
        every = np.concatenate(found)
        owner, back = np.unique(every["row"], return_inverse=True)
        columns = [owner, *(np.bincount(back, weights=every[c], minlength=len(owner)) for c in ("known", "base", "log"))]
        columns[1] = columns[1].astype(np.int64)
        made = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "known", "base_more", "log_more"])
        for i in range(0, made.num_rows, 1 << 16):
            yield made.slice(i, 1 << 16)

    questions = scanned.where("part is not null").select("part", "hashes", "rows", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("logs"))
    known = judged.select("part", "hashes", none.alias("rows"), "counts", "logs").unionByName(windows.select("part", "hashes", none.alias("rows"), none.alias("counts"), "logs"))
    sums = questions.unionByName(known).repartitionById(parts, F.col("part")).mapInArrow(tidy(meet), "block long, sums binary")
    more = sums.repartition(parts, "block").mapInArrow(tidy(add_up), "row long, known long, base_more double, log_more double")
    full = scanned.where("part is null").join(more, "row", "left")
    nothing = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_token = float(np.log10(total + SMOOTH * (distinct + 1)))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + nothing("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + nothing("base_more") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("log") + nothing("log_more")).alias("score"),
    )
