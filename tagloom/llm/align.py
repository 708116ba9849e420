"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often.

Tokenizer A is a byte-level tokenizers file, B a sentencepiece model. A encodes a space and the text, B the
text (it adds the space); strings of special tokens are plain text. Byte offsets where tokens of both
end cut them into groups; every A token and B token whose byte ranges overlap are a link. The
count of a pair of ids is the number of documents that hold it linked, in the whole corpus.

Units. Texts are cut where both tokenizers certainly have a boundary (before a single space or line
feed between two characters that are no white space; B's vocabulary is checked for pieces that
would cross one), so a unit's tokens, groups and links are worked out once and kept in a bounded
memo. All new units of a batch are aligned together: the union of both sides' token ends
cuts the bytes into segments, and each segment is one link.

Counting. A's ids are dealt to stripes, every n-th id to one, so frequent ids lie apart. A task
encodes documents in chunks of bounded size and writes, for each chunk and stripe, the links
(pair, document, occurrences) and the pairs with their documents, both packed. Stripes of pairs are
shuffled and added with np.add.at to a dense block of one stripe's ids times B's vocabulary, whose
row maxima are the best counts. Links are scored where their stripe's block is, which takes one
block and one chunk's links in memory, and sums by document go back to the chunk. Stripes of
very many chunks are split over tasks by chunk.

Bounds. A chunk has about ``LINKS`` links or one document; a block has ``ROWS`` ids times B's vocabulary. Broadcast
are the two tokenizer files (a few MB). Everything else is written or shuffled in blobs of a
few bytes for each link.

Defined cases. A text that is null or empty, or whose A or B tokens don't give back the space and the text
byte for byte, has no tokens: all numbers are 0 and groups_sha256 is ''. Rows that repeat are documents each.
Null ids stay null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, compress, count, pairwise, repeat
from operator import is_, itemgetter

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import finished, materialise, small_batches, tidy
from tagloom.llm.tokenise import _INSIDE, LONG_WORD, Encoder, _segments, held, read_file

MEMO, GROUP, CHUNK = 300_000, 200, 1 << 20
LINKS, DOCS, ROWS, SPLIT = 1 << 21, 1 << 15, 256, 4096
WORD_MARK = "▁"
#: Fixed value: how byte-level tokenizers split a text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: (groups as text, each ended by ";"; codes of the links; n_a + n_b * 2**31) of a unit.
Unit = tuple[bytes, bytes, int]
#: (groups as text, codes of all links, n_a, n_b) of a text; None of one without tokens.
Found = tuple[bytes, np.ndarray, int, int] | None
#: (digest of the groups, codes of the links, their occurrences if not one each, NUMBERS) of a document, or None.
Document = tuple[bytes, np.ndarray, np.ndarray | None, tuple[int, int, int, int]] | None
#: A unit whose tokens don't give its bytes back.
NO_TOKENS: Unit = (b"", b"", -(1 << 100))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each in as few bytes as its largest needs, byte by byte."""
    parts = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = np.dtype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        planes = np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T
        parts.append(np.array([len(a), kind.itemsize], "<u4").tobytes() + planes.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, size = np.frombuffer(data, "<u4", 2, at).tolist()
        planes = np.frombuffer(data, np.uint8, n * size, at + 8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1).astype(np.int64))
        at += 8 + n * size
    return out


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_)))


def pack_links(codes: np.ndarray, docs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """(links, pairs with their documents) of one stripe, sorted by code and document."""
    starts, lengths = _runs(codes)
    step = np.diff(docs, prepend=0)
    step[starts] = docs[starts]
    pairs = np.diff(codes[starts], prepend=0)
    return pack(pairs, lengths, step, times), pack(pairs, lengths)


def unpack_links(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the pairs, documents of each, document of each link, occurrences of each link)."""
    pairs, lengths, step, times = unpack(blob)
    total = np.cumsum(step)
    starts = np.cumsum(lengths) - lengths
    return np.cumsum(pairs), lengths, total - np.repeat(total[starts] - step[starts], lengths), times


class Striped:
    """Where the ids of A lie: every n-th id in one stripe, a row of its block each."""

    def __init__(self, vocab_a: int, vocab_b: int, rows: int = ROWS):
        self.stripes, self.vocab_b = -(-vocab_a // rows), vocab_b
        self.rows = -(-vocab_a // self.stripes)
        ids = np.arange(vocab_a, dtype=np.int64)
        self.place = (ids % self.stripes * self.rows + ids // self.stripes) * vocab_b
        self.cells = self.rows * vocab_b
        self.kind = np.dtype("<u4" if self.stripes * self.cells < 1 << 32 else "<u8")


def _quick(file: bytes, tokens: list[bytes]) -> tiktoken.Encoding | None:
    """An encoder of byte-level BPE by ranks, if the file's merges come in the order of the ids that they make;
    then a pair's rank and that of what it makes are the same, and so are all results."""
    model = json.loads(file)["model"]
    vocab, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    if model.get("type") != "BPE" or len(vocab) - len(merges) not in (256, 257) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    if sorted(tokens[:256]) != [bytes([b]) for b in range(256)]:
        return None
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(merges)])}, special_tokens={})


class Aligner:
    """Tokens, groups and links of texts, by units that are remembered."""

    def __init__(self, file_a: bytes, file_b: bytes, memo: int = MEMO):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(file_a, memo=0, plain=True), SentencePieceProcessor(model_proto=file_b)
        unseen = {c: b for b, c in self.a.visible.items() if b != 32} | {"Ġ": 32} if self.a.rule == "spaced" else {}
        as_byte = {chr(b): b for b in range(256) if chr(b) not in unseen and b not in unseen.values()} | unseen
        self.a_bytes = [bytes(as_byte[c] for c in t) if all(c in as_byte for c in t) else t.encode() for t in (self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.vocab))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(WORD_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = self.a.rule == "spaced" and not any(WORD_MARK in p.lstrip(WORD_MARK) or "\n" in p for p in pieces)
        self.a_len, self.b_len = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.striped = Striped(self.a.vocab, len(pieces))
        names = [[b"%d" % i for i in range(n)] for n in (self.a.vocab, len(pieces))]
        self.text = [x + end for side, ends in zip(names, (b",|", b",;"), strict=True) for end in (ends[:1], ends[1:]) for x in side]
        self.text_len = np.array([len(t) for t in self.text], np.int64)
        self.quick = _quick(file_a, self.a_bytes) if self.a.rule == "spaced" else None
        self.limit = memo
        self.young: dict[str, Unit] = {}
        self.old: dict[str, Unit] = {}

    def _aligned(self, texts: list[bytes], a: np.ndarray, b: np.ndarray) -> list[Unit] | None:
        """The units, from their bytes and all ids of both sides; None if the ids don't give each text back."""
        whole, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        for side, table, reach in ((a, self.a_bytes, a_end), (b, self.b_bytes, b_end)):
            if not len(reach) or reach[-1] != ends[-1] or (reach[np.searchsorted(reach, ends)] != ends).any() or b"".join(map(table.__getitem__, side.tolist())) != whole:
                return None
        a_at, b_at = np.zeros((2, int(ends[-1]) + 1), bool)
        a_at[a_end], b_at[b_end] = True, True
        every, both = np.flatnonzero(a_at | b_at), np.flatnonzero(a_at & b_at)
        a_before, b_before = np.cumsum(a_at) - a_at, np.cumsum(b_at) - b_at  # tokens that end before each byte
        codes = self.striped.place[a[a_before[every]]] + b[b_before[every]]
        blob, size = codes.astype(self.striped.kind).tobytes(), self.striped.kind.itemsize
        a_shut, b_shut = b_at[a_end], a_at[b_end]
        a_upto, b_upto = (np.concatenate(([0], x[both] + 1)) for x in (a_before, b_before))
        named = np.empty(len(a) + len(b), np.int64)
        named[np.arange(len(a)) + b_upto[np.cumsum(a_shut) - a_shut]] = a + a_shut * self.a.vocab
        named[np.arange(len(b)) + a_upto[np.cumsum(b_shut) - b_shut + 1]] = 2 * self.a.vocab + b + b_shut * len(self.b_bytes)
        groups = b"".join(map(self.text.__getitem__, named.tolist()))
        a_n, b_n, links = a_before[ends] + 1, b_before[ends] + 1, np.cumsum(a_at | b_at)[ends]
        numbers = (np.diff(a_n, prepend=0) + (np.diff(b_n, prepend=0) << 31)).tolist()
        cuts, bounds = [0, *np.cumsum(self.text_len[named])[a_n + b_n - 1].tolist()], [0, *(links * size).tolist()]
        return [(groups[u:v], blob[x:y], n) for u, v, x, y, n in zip(cuts, cuts[1:], bounds, bounds[1:], numbers, strict=False)]

    def _a_ids(self, units: list[str], lines: bool) -> np.ndarray:
        """All of A's ids of units one after the other. Plain ASCII has the same splits in every version of Unicode and takes a shorter way."""
        if self.quick and all(map(str.isascii, units)):
            return np.array(self.quick.encode_ordinary("".join(units) if lines else " " + " ".join(units)), np.int64)
        known = self.a._learn(units)
        return np.frombuffer(b"".join(known[u] if u in known else self.a.whole(u if lines else " " + u).tobytes() for u in units), self.a.dtype).astype(np.int64)

    def _learn_some(self, units: list[str], lines: bool) -> list[Unit]:
        """Units that all follow a space, or all are led by a line feed."""
        groups = (units[i : i + GROUP] for i in range(0, len(units), GROUP))
        b = np.array([x for g in groups for x in (self.b.encode("".join(g))[1:] if lines else self.b.encode(" ".join(g)))], np.int64)
        found = self._aligned([(u if lines else " " + u).encode() for u in units], self._a_ids(units, lines), b)
        if found is None and len(units) > 1:
            half = len(units) // 2
            return self._learn_some(units[:half], lines) + self._learn_some(units[half:], lines)
        return found or [NO_TOKENS]

    def _learn(self, units: Iterable[str]) -> dict[str, Unit]:
        """Units by their text; none for those with white space at an end."""
        kinds: dict[tuple[bool, bool], list[str]] = {}
        for u in units:
            lines = u.startswith("\n")
            bare = u[1:] if lines else u
            if bare and bare.strip() == bare:
                kinds.setdefault((lines, u.isascii()), []).append(u)
        out = {}
        for (lines, _), some in kinds.items():
            for i in range(0, len(some), GROUP * 20):
                part = some[i : i + GROUP * 20]
                out.update(zip(part, self._learn_some(part, lines), strict=True))
        return out

    def _units(self, lists: list[list[str]]) -> list[list[Unit | None]]:
        """The units of each list, None for one that can't be cut out."""
        every = list(chain.from_iterable(lists))
        found = list(map(self.young.get, every))
        lacking = list(compress(count(), map(is_, found, repeat(None))))
        if lacking:
            wanted = {every[i] for i in lacking}
            known = {u: self.old[u] for u in wanted if u in self.old}
            fresh = self._learn(wanted.difference(known))
            if len(self.young) + len(known) + len(fresh) > self.limit:
                self.old, self.young = self.young, {}
            known.update(fresh)
            self.young.update(known if max(map(len, wanted)) <= LONG_WORD else {u: x for u, x in known.items() if len(u) <= LONG_WORD})
            for i in lacking:
                found[i] = known.get(every[i])
        ends = [0, *accumulate(map(len, lists))]
        return [found[a:b] for a, b in pairwise(ends)]

    def _whole(self, text: str) -> Unit:
        """A text that isn't cut, after a space."""
        found = self._aligned([(" " + text).encode()], self.a.whole(" " + text).astype(np.int64), np.array(self.b.encode(text), np.int64))
        return found[0] if found else NO_TOKENS

    def _carefully(self, text: str) -> list[Unit]:
        """Units of a text with runs of white space: cut only at single spaces."""
        if not self.cuts:
            return [self._whole(text)]
        parts = _INSIDE.split(text)
        bare = [p for p in parts if p.split() == [p]]
        known = dict(zip(bare, self._units([bare])[0], strict=True))
        return [known.get(p) or self._whole(p) for p in parts]

    def _many(self, texts: list[str]) -> Iterator[Found]:
        plain = [self.cuts and "\n\n" not in t and "  " not in t for t in texts]
        cut = [t.replace("\n", " \n").split(" ") if ok else [] for t, ok in zip(texts, plain, strict=True)]
        for text, some in zip(texts, self._units(cut), strict=True):
            if not some or None in some:
                some = self._carefully(text)
            total = sum(map(itemgetter(2), some))
            if total < 0:
                yield None
                continue
            codes = np.frombuffer(b"".join(map(itemgetter(1), some)), self.striped.kind)
            yield b"".join(map(itemgetter(0), some)), codes, total & (1 << 31) - 1, total >> 31

    def _long(self, text: str) -> Document:
        """A long text, segment by segment."""
        digest, codes, times = hashlib.sha256(), np.empty(0, self.striped.kind), np.empty(0, np.int64)
        numbers, last = np.zeros(4, np.int64), b""
        for segment in _segments(text, _INSIDE):
            found, = self._many([segment])
            if found is None:
                return None
            groups, more, n_a, n_b = found
            digest.update(last + groups[:-1])
            last = b";"
            numbers += (n_a, n_b, groups.count(b";"), len(more))
            every, again = np.unique(np.concatenate((codes, more)), return_inverse=True)
            times = np.bincount(again, np.concatenate((times, np.ones(len(more), np.int64))), len(every)).astype(np.int64)
            codes = every
        return digest.digest(), codes, times, tuple(numbers.tolist())

    def documents(self, texts: list[str | None]) -> Iterator[Document]:
        """What each text has; short texts are aligned together, CHUNK characters at once."""
        waiting: list[str] = []
        size = 0

        def flush() -> Iterator[Document]:
            for found in self._many(waiting):
                if found is None:
                    yield None
                else:
                    groups, codes, n_a, n_b = found
                    yield hashlib.sha256(groups[:-1]).digest(), codes, None, (n_a, n_b, groups.count(b";"), len(codes))
            waiting.clear()

        for text in texts:
            if text and len(text) <= CHUNK and size + len(text) <= CHUNK:
                waiting.append(text)
                size += len(text)
                continue
            yield from flush()
            size = 0
            if not text:
                yield None
            elif len(text) <= CHUNK or not self.cuts:
                waiting.append(text)
                size = len(text)
            else:
                yield self._long(text)
        yield from flush()


class _Chunk:
    """Documents until their links are enough for one write."""

    def __init__(self, striped: Striped):
        self.striped, self.held = striped, 0
        self.keys: list[int | None] = []
        self.docs: list[Document] = []

    def add(self, key: int | None, doc: Document) -> None:
        self.keys.append(key)
        self.docs.append(doc)
        self.held += len(doc[1]) if doc else 0

    @property
    def full(self) -> bool:
        return self.held >= LINKS or len(self.docs) >= DOCS

    def rows(self) -> Iterator[tuple[int, bytes | None, bytes | None, bytes | None]]:
        """(stripe, links, pairs, documents), the documents as stripe -1."""
        none = (b"\0" * 32, np.empty(0, self.striped.kind), None, (0, 0, 0, 0))
        docs = [d or none for d in self.docs]
        keys = np.array([k or 0 for k in self.keys], np.int64).view(np.uint64)
        numbers = np.array([d[3] for d in docs], np.int64).reshape(-1, len(NUMBERS))
        yield -1, None, None, pack(keys, np.array([k is not None for k in self.keys]), np.frombuffer(b"".join(d[0] for d in docs), np.uint8), *numbers.T)
        sizes = [len(d[1]) for d in docs]
        key = np.concatenate([d[1] for d in docs]).astype(np.uint64) << np.uint64(16) | np.repeat(np.arange(len(docs), dtype=np.uint64), sizes)
        if any(d[2] is not None for d in docs):
            order = np.argsort(key)
            key, times = key[order], np.concatenate([np.ones(len(d[1]), np.int64) if d[2] is None else d[2] for d in docs])[order]
            starts, _ = _runs(key)
            key, times = key[starts], np.add.reduceat(times, starts) if len(starts) else times
        else:
            key, times = np.unique(key, return_counts=True)
        codes, places = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64)
        bounds = np.searchsorted(codes, np.arange(self.striped.stripes + 1) * self.striped.cells)
        for stripe, (lo, hi) in enumerate(pairwise(bounds.tolist())):
            if hi > lo:
                yield stripe, *pack_links(codes[lo:hi] - stripe * self.striped.cells, places[lo:hi], times[lo:hi]), None


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _encoded(df: DataFrame, file_a: str, file_b: str, id_col: str, text_col: str) -> DataFrame:
    """(chunk, stripe, links, pairs, documents), written."""
    files = df.sparkSession.sparkContext.broadcast((read_file(file_a), read_file(file_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(files.value, lambda: Aligner(*files.value))
        number = TaskContext.get().partitionId() << 33

        def rows() -> Iterator[tuple]:
            nonlocal number
            chunk = _Chunk(aligner.striped)
            for batch in batches:
                for key, doc in zip(batch.column(0).to_pylist(), aligner.documents(batch.column(1).to_pylist()), strict=True):
                    chunk.add(key, doc)
                    if chunk.full:
                        yield from ((number, *row) for row in chunk.rows())
                        chunk, number = _Chunk(aligner.striped), number + 1
            if chunk.docs:
                yield from ((number, *row) for row in chunk.rows())

        yield from _batches(rows(), ["chunk", "stripe", "links", "pairs", "documents"], [pa.int64(), pa.int32(), *[pa.binary()] * 3])

    picked = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return materialise(picked.mapInArrow(tidy(run, encodes=True), "chunk long, stripe int, links binary, pairs binary, documents binary"), "links", compression="none")


def _sum_blocks(striped: Striped, last: bool):
    """(group, stripe, pairs) sorted by group -> (stripe, pairs) of each group, summed in one dense block; the last
    sums also tell which pairs have their row's maximum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(striped.cells, np.int64)

        def summed(stripe: int) -> tuple[int, bytes]:
            codes = np.flatnonzero(block)
            counts = block[codes]
            best = (block.reshape(striped.rows, -1).max(axis=1)[codes // striped.vocab_b] == counts,) if last else ()
            block[codes] = 0
            return stripe, pack(np.diff(codes, prepend=0), counts, *best)

        def rows() -> Iterator[tuple]:
            now = None
            for group, stripe, pairs in _rows(batches):
                if now is not None and now[0] != group:
                    yield summed(now[1])
                now = (group, stripe)
                codes, counts = unpack(pairs)
                np.add.at(block, np.cumsum(codes), counts)
            if now is not None:
                yield summed(now[1])

        yield from _batches(rows(), ["stripe", "pairs"], [pa.int32(), pa.binary()])

    return run


def _scored(striped: Striped):
    """(group, kind, chunk, blob) sorted by group and kind, a group's block first -> (chunk, sums by document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, best, filled = np.zeros(striped.cells, np.int64), np.zeros(striped.cells, bool), np.empty(0, np.int64)

        def rows() -> Iterator[tuple]:
            nonlocal filled
            for _, kind, chunk, blob in _rows(batches):
                if kind == 0:
                    value[filled], best[filled] = 0, False
                    codes, counts, most = unpack(blob)
                    filled = np.cumsum(codes)
                    value[filled], best[filled] = counts, most.astype(bool)
                    continue
                codes, lengths, docs, times = unpack_links(blob)
                sums, hits = np.zeros((2, int(docs.max()) + 1), np.int64)
                np.add.at(sums, docs, np.repeat(value[codes], lengths) * times)
                np.add.at(hits, docs, np.repeat(best[codes], lengths) * times)
                there = np.flatnonzero(sums)
                yield chunk, pack(np.diff(there, prepend=0), hits[there], sums[there])

        yield from _batches(rows(), ["chunk", "blob"], [pa.int64(), pa.binary()])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, kind, blob) sorted by chunk and kind, a chunk's documents first -> the result's rows."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def out(docs: list[np.ndarray], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, there, digests, *numbers = docs
        hexed = [bytes(d).hex() if n else "" for d, n in zip(digests.astype(np.uint8).reshape(-1, 32), numbers[0].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=there == 0), *map(pa.array, numbers), *map(pa.array, sums), pa.array(hexed, pa.string())], names)

    docs = sums = None
    for _, kind, blob in _rows(batches):
        if kind == 0:
            if docs is not None:
                yield from out(docs, sums)
            docs = unpack(blob)
            sums = np.zeros((2, len(docs[0])), np.int64)
        else:
            there, hits, more = unpack(blob)
            sums[:, np.cumsum(there)] += (hits, more)
    if docs is not None:
        yield from out(docs, sums)


def _align(df: DataFrame, file_a: str, file_b: str, id_col: str, text_col: str) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    written = _encoded(df, file_a, file_b, id_col, text_col)
    aligner = Aligner(read_file(file_a), read_file(file_b))
    striped = aligner.striped
    chunks = written.where("stripe = -1").count()
    splits = max(1, -(-chunks // SPLIT))
    groups = striped.stripes * splits
    parts = max(1, min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), striped.stripes if splits > 1 else 1)))

    def dealt(rows: DataFrame, key: str, *order: str) -> DataFrame:
        return rows.repartitionById(parts, F.expr(f"cast(pmod({key}, {parts}) as int)")).sortWithinPartitions(key, *order)

    group = F.col("stripe") * splits + F.pmod(F.xxhash64("chunk"), F.lit(splits)).cast("int")
    linked = written.where("stripe >= 0")
    pairs = linked.select(group.alias("group"), "stripe", "pairs")
    partial = dealt(pairs, "group").mapInArrow(tidy(_sum_blocks(striped, False)), "stripe int, pairs binary")
    blocks = dealt(partial.select(F.col("stripe").alias("group"), "stripe", "pairs"), "group").mapInArrow(tidy(_sum_blocks(striped, True)), "stripe int, pairs binary")
    each = blocks.select(F.explode(F.sequence(F.col("stripe") * splits, F.col("stripe") * splits + (splits - 1))).alias("group"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.col("pairs").alias("blob"))
    links = linked.select(group.alias("group"), F.lit(1).alias("kind"), "chunk", F.col("links").alias("blob"))
    sums = dealt(each.unionByName(links), "group", "kind").mapInArrow(tidy(_scored(striped)), "chunk long, blob binary")
    docs = written.where("stripe = -1").select("chunk", F.lit(0).alias("kind"), F.col("documents").alias("blob"))
    back = docs.unionByName(sums.select("chunk", F.lit(1).alias("kind"), "blob")).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return back.mapInArrow(tidy(_gathered), SCHEMA)


def align(df: DataFrame, file_a: str, file_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: tokens of both sides, groups, links, links whose count is their A id's
    highest (ties included), the sum of the counts of its links, and a digest of the groups."""
    return finished(lambda: _align(df, file_a, file_b, id_col, text_col), "aligned")
