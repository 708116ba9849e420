"""Harmonic packing of token sequences into training sequences.

A piece of length n belongs to class k = capacity // n, the reciprocal-capacity class
(capacity / (k + 1), capacity / k]; a bin of class k holds exactly k pieces. Every worker
fills the bins of its own partition, so nothing is shuffled and no state is shared.

Documents may be cut, so they are cut to fit: full capacity first; then, as long as the
rest would waste more than ``slack`` of its bin, the largest piece capacity // k that fits,
until the rest is at most ``tail`` tokens. What is left in bins that did not fill up by the
end of a partition is laid end to end, cut at the capacity, and the last sequence is cut
into powers of two, which need no padding.

Defined cases. A null or empty text is its end id alone. Rows that repeat are packed
each. Null ids stay null. An empty table gives no pieces. Memory: per partition one
document and less than one bin for each class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import small_batches, tidy
from tagloom.llm.tokenise import read_file, shared

CAPACITY, SLACK, TAIL = 4096, 0.01, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(tokens: int, capacity: int = CAPACITY, slack: float = SLACK, tail: int = TAIL) -> list[int]:
    """The lengths of the pieces of a document, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        if rest <= tail or capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Packer:
    """Fills bins; each piece comes out as (key, start, ids, doc tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open = first_sequence, capacity, {}

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for n in cuts(len(ids), self.capacity):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((key, start, ids[start : start + n].copy(), len(ids)))
            start += n
            if len(bin_) == k:
                yield from self._close(self.open.pop(k))

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, ids, total in pieces:
            yield key, start, ids, total, self.next, at
            at += len(ids)
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        rest = total % self.capacity
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        left.reverse()
        for size in sizes:
            filled = []
            while size:
                key, start, ids, whole = left.pop()
                if len(ids) > size:
                    left.append((key, start + size, ids[size:], whole))
                    ids = ids[:size]
                filled.append((key, start, ids, whole))
                size -= len(ids)
            yield from self._close(filled)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    crc = [zlib.crc32(np.ascontiguousarray(r[2], "<u4")) for r in rows]
    cols = ([r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], crc, [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows])
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False, plain: bool = False) -> DataFrame:
    """One row per piece. with_ids adds the ids themselves as column ``ids`` (array of int).
    Strings of special tokens become their ids unless ``plain``.

    sequence_id is the number of the partition times 2**33 plus a count, so it is unique
    over all workers and the same when a lost task runs again.
    """
    small_batches(df.sparkSession)
    file = df.sparkSession.sparkContext.broadcast(read_file(tokenizer))  # a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, rows = shared(file.value, plain), Packer(TaskContext.get().partitionId() << 33, capacity), []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            made = _batch(rows)
            return made.append_column("ids", pa.array([r[2].astype("i4") for r in rows], pa.list_(pa.int32()))) if with_ids else made

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.many(batch.column(1).to_pylist()), strict=True):
                rows += packer.add(key, np.append(ids, encoder.dtype.type(end_id)))
                if len(rows) >= 4096:
                    yield out(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield out(rows)

    picked = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(tidy(run, encodes=True), SCHEMA + (", ids array<int>" if with_ids else ""))
