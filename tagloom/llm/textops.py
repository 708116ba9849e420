"""Words and word n-grams of whole Arrow batches, hashed in numpy without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Its hash is a
64-bit polynomial over a fixed random table of its bytes, finished with a mixer; n-grams
combine the hashes of their words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_rng = np.random.default_rng(20240117)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_TABLE = _TABLE[_FOLD]
_TABLE[_SPACE] = 0
#: Another cut: every ASCII byte that is neither letter nor digit stands between words.
LETTERS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(CHUNK + 1, n)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if size == CHUNK + 1:  # longer ones aren't kept
            _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def hash_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): the words of document d are bounds[d] to bounds[d + 1]."""
    words, bounds, _, _, _ = find_words(data, offsets, between)
    return words, bounds


def find_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes, bounds, starts, ends, hashes of the first ``stem`` bytes); starts and ends count from the
    first offset. A text over CHUNK bytes is taken in pieces that end between words."""
    base = int(offsets[0])
    raw = data[base : int(offsets[-1])]
    cut = offsets - base
    if len(cut) > 2 or len(raw) <= CHUNK:
        hashes, starts, ends, stems = _words_of(raw, cut[1:-1], between, stem)
    else:
        found, at = [], 0
        while at < len(raw):
            stop = min(len(raw), at + CHUNK)
            while stop < len(raw) and not between[raw[stop]]:
                gap = np.flatnonzero(between[raw[stop : stop + 4096]])
                stop = stop + int(gap[0]) if len(gap) else min(len(raw), stop + 4096)
            h, s, e, t = _words_of(raw[at:stop], cut[:0], between, stem)
            found.append((h, s + at, e + at, t if stem else h[:0]))
            at = stop
        hashes, starts, ends, stems = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, np.searchsorted(starts, cut), starts, ends, stems if stem else None


def _words_of(raw: np.ndarray, edges: np.ndarray, between: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    inside = ~between[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * _power(_BASE, len(raw)), out=total[1:])
    return hash_span(total, starts, ends), starts, ends, hash_span(total, starts, np.minimum(ends, starts + stem)) if stem else None


def hash_span(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges from the prefix sums of find_words()."""
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(total))[starts])


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each document, the sorted distinct hashes of its n-grams of width words; of fewer
    words, the whole sequence as one; of none, nothing."""
    n = len(words) - width + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        grams = grams * np.uint64(_BASE) + words[k : k + n]
    grams = mix(grams)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            value = b - a
            for w in words[a:b].tolist():
                value = (value * _BASE + w + 1) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([value], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
