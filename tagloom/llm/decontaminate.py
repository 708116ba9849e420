"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if it contains the item with at most
floor(max_error * length) edits. Both are compared in lower case with every run of
characters that are neither letters nor digits as one space. An item with an error budget
of k is cut into k + 1 pieces; whatever holds the item with k edits holds one piece
unchanged. One Aho-Corasick automaton finds all pieces in a document, and Myers'
bit-parallel distance verifies the stretch around each hit, from which a piece's place in
the item tells where the item must lie.

One rule holds for items of every length: an item has a space on either side, as a text has at its
ends, and these count as its characters. So an item that stands inside a word lacks one or two of its
characters, which its budget may allow or not.

The benchmark is the query set, cut into blocks of at most ``block_chars`` characters (or one item). One
block is broadcast; more are written to the shared folder by tasks and read there one by one, so the driver
holds one block at most. Documents are read once: a task holds up to ``hold_chars`` characters of
them (or one) and takes the blocks in turn, with one block's automaton at a time.

Defined cases. Null text or an empty table gives no match; null items and items without a letter
or digit are no evidence and match nothing. Repeated documents are each reported, repeated items
too. Null ids are reported as null. Other columns are ignored by find_leaks(); clean() decides by
row, whatever its id, and keeps all columns. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import filesystem, materialise, small_batches, tidy

MAX_ERROR, BLOCK_CHARS, HOLD_CHARS = 0.08, 1 << 20, 1 << 23
SCHEMA = "doc_id long, item_id long, errors long, start long, stop long"
_BETWEEN = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _BETWEEN.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(place, piece): the item in budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_end(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of item in text, the first of equals, within budget."""
    n = len(item)
    full, high = (1 << n) - 1, 1 << (n - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best = full, 0, n, None
    for end, c in enumerate(text, 1):
        eq = at.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        vertical = eq | down
        plus, minus = (down | ~(across | up)) & full, up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
        if score <= budget and (best is None or score < best[0]):
            best = score, end
    return best


def locate(item: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the best place of item in text, if within budget."""
    exact = text.find(item)
    if exact >= 0:
        return 0, exact, exact + len(item)
    found = best_end(item, text, budget)
    if found is None:
        return None
    edits, stop = found
    back = best_end(item[::-1], text[:stop][::-1][: len(item) + edits], edits)
    return edits, stop - back[1], stop


class Matcher:
    """Items with a space on either side, in texts with a space on either side."""

    def __init__(self, items: list[tuple[int | None, str]], max_error: float):
        import ahocorasick

        self.items = [(key, f" {text} ", int(max_error * len(text))) for key, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item, budget) in enumerate(self.items):
            for place, piece in pieces(item, budget):
                found.setdefault(piece, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """(item id, edits, start, stop) for each item that the normalised text contains."""
        spans: dict[int, list[list[int]]] = {}
        if not self.items:
            return
        padded = f" {text} "
        for last, (size, where) in self.automaton.iter(padded):
            for i, place in where:
                begin = last + 1 - size - place
                budget, held = self.items[i][2], spans.setdefault(i, [])
                lo, hi = max(0, begin - budget), begin + len(self.items[i][1]) + budget
                if held and held[-1][0] <= lo <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], hi)
                else:
                    held.append([lo, hi])
        for i, held in sorted(spans.items()):
            key, item, budget = self.items[i]
            best = None
            for lo, hi in _joined(held):
                found = locate(item, padded[lo:hi], budget)
                if found and (best is None or found[0] < best[0]):
                    best = found[0], found[1] + lo, found[2] + lo
                    if not found[0]:
                        break
            if best:
                yield key, best[0], min(best[1], len(text)), max(0, min(best[2] - 2, len(text)))


def _joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _blocks(rows: Iterable[tuple[int | None, str | None]], limit: int) -> Iterator[list[tuple[int | None, str]]]:
    held, size = [], 0
    for key, raw in rows:
        text = plain(raw)
        if not text:
            continue
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((key, text))
        size += len(text)
    if held:
        yield held


class _Written:
    """Blocks in files of the shared folder, of which a task holds one at a time."""

    def __init__(self, items: DataFrame, limit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for block in _blocks(rows, limit):
                yield pa.RecordBatch.from_arrays([pa.array([[k for k, _ in block]], pa.list_(pa.int64())), pa.array([[t for _, t in block]], pa.list_(pa.string()))], ["keys", "texts"])

        self.files = sorted(materialise(items.mapInArrow(tidy(run), "keys array<long>, texts array<string>"), "items").inputFiles())

    def __iter__(self) -> Iterator[list[tuple[int | None, str]]]:
        import pyarrow.parquet as pq

        for uri in self.files:
            fs, path = filesystem(uri)
            with fs.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(batch_size=1):
                    for keys, texts in zip(batch.column("keys").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                        yield list(zip(keys, texts, strict=True))


class _Broadcast:
    """One block, or none."""

    def __init__(self, items: DataFrame, limit: int):
        rows = ((r["k"], r["t"]) for r in items.collect())  # at most limit characters
        self.blocks = [items.sparkSession.sparkContext.broadcast(b) for b in _blocks(rows, limit)]

    def __iter__(self) -> Iterator[list[tuple[int | None, str]]]:
        return (b.value for b in self.blocks)


class _Search:
    """All blocks of items, as a task holds them against documents."""

    def __init__(self, items: DataFrame, item_col: str, text_col: str, max_error: float, block_chars: int, hold_chars: int):
        listed = items.select(F.col(item_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).where("t is not null")
        size = listed.agg(F.coalesce(F.sum(F.char_length("t") + 1), F.lit(0)).alias("n")).first()["n"]
        self.single = size <= block_chars
        self.blocks = (_Broadcast if self.single else _Written)(listed, 2 * block_chars if self.single else block_chars)
        self.max_error, self.hold = max_error, hold_chars

    def __call__(self, batches: Iterator[pa.RecordBatch], text_of: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        """Each batch with the matches of its rows."""
        matcher = Matcher([x for block in self.blocks for x in block], self.max_error) if self.single else None
        held: list[tuple[pa.RecordBatch, list[str]]] = []
        size = 0

        def search() -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
            found = [[[] for _ in texts] for _, texts in held]
            for m in [matcher] if matcher else (Matcher(block, self.max_error) for block in self.blocks):
                for rows, (_, texts) in zip(found, held, strict=True):
                    for row, text in zip(rows, texts, strict=True):
                        row += m.matches(text)
            yield from zip((batch for batch, _ in held), found, strict=True)

        for batch in batches:
            texts = [plain(text.as_py()) for text in batch.column(text_of)]
            held.append((batch, texts))
            size += sum(map(len, texts))
            if matcher or size > self.hold:
                yield from search()
                held, size = [], 0
        if held:
            yield from search()


def find_leaks(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_error: float = MAX_ERROR, block_chars: int = BLOCK_CHARS, hold_chars: int = HOLD_CHARS) -> DataFrame:
    """(doc_id, item_id, errors, start, stop) for each document and item that it contains;
    start and stop count characters of the normalised text."""
    small_batches(df.sparkSession)
    search = _Search(items, item_col, item_text_col, max_error, block_chars, hold_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in search(batches, 1):
            rows = [(key, *match) for key, matches in zip(batch.column(0).to_pylist(), found, strict=True) for match in matches]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "errors", "start", "stop"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), SCHEMA)


def clean(df: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_error: float = MAX_ERROR, block_chars: int = BLOCK_CHARS, hold_chars: int = HOLD_CHARS) -> DataFrame:
    """The rows of df that contain no item, with all their columns."""
    small_batches(df.sparkSession)
    search = _Search(items, item_col, item_text_col, max_error, block_chars, hold_chars)
    place = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in search(batches, place):
            yield batch.filter(pa.array([not matches for matches in found], pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
