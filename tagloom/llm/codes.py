"""Vector code compression: a product quantizer with integer codebooks.

Each component x becomes the integer floor(scale * x), and each vector is cut into equal
consecutive parts. Every part position has a codebook of integer entries, at first the
parts of the vectors with the smallest ids. A round assigns each part to its nearest entry
(squared distance, ties to the lower index) and moves each entry to the floor of the mean
of its parts; an entry without parts stays.

On Spark: a round is one scan. The codebooks are broadcast (parts x entries rows of a part's
width, whatever the corpus); tasks take Arrow batches, compute all distances as
|x|^2 - 2 x.c + |c|^2 by int64 matrix products and take the first argmin. A task sends one
row for each entry it met, with count and sums, and a grouped shuffle merges those, so no
vector is ever shuffled and a hot label or entry is no hot key.

All numbers are integers, so the result is the same in any order and on any partitioning.
Where the largest components of a batch would let a squared distance pass 63 bits, that
batch is computed in Python's integers. An error or a sum that needs more than 63 bits has
no long, and raises OverflowError.

Defined cases. Rows are left out whose vector is null, empty or of another length than most
vectors of the table, or holds a component that is null, not finite or 2**62 / scale or more. Null ids come after all
others when the first entries are chosen; equal ids are taken in the order of their vectors.
Rows that repeat are coded each. With fewer vectors than entries, a codebook has as many
entries as there are vectors. An empty table has no codebooks and gives no rows. Other columns
stay; those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.joins import look_up
from tagloom.llm.store import materialise, small_batches, tidy, unused

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a batch whose distances are held at once.
ROWS = 1024


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position], integers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, its squared distance) of each part; vectors[row, part, position]."""
        codes = np.empty(vectors.shape[:2], np.int64)
        away = np.empty(vectors.shape[:2], np.int64)
        for p, book in enumerate(self.entries):
            for i in range(0, len(vectors), ROWS):
                far = _distances(vectors[i : i + ROWS, p], book)
                best = far.argmin(axis=1)
                codes[i : i + ROWS, p] = best
                away[i : i + ROWS, p] = far[np.arange(len(far)), best]
        return codes, away


def _distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """All squared distances, exact."""
    if rows.size and rows.shape[1] * (int(np.abs(rows).max()) + int(np.abs(book).max())) ** 2 >= 1 << 62:
        rows, book = rows.astype(object), book.astype(object)
    return (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ book.T) + (book * book).sum(axis=1)


def _whole(vectors: pa.ListArray, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integer vectors) of the rows that can be coded."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    starts = vectors.offsets.to_numpy()[:-1].astype(np.int64)
    right = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.diff(vectors.offsets.to_numpy()) == dims)
    flat = vectors.values.to_numpy(zero_copy_only=False)  # a null component is NaN
    rows = np.flatnonzero(right)
    found = flat[starts[rows][:, None] + np.arange(dims)] * scale
    finite = (np.abs(found) < 2.0**62).all(axis=1)
    return rows[finite], np.floor(found[finite]).astype(np.int64)


def _read(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))


def _first(df: DataFrame, dims: int, scale: int, entries: int) -> np.ndarray:
    """The vectors of the smallest ids; each task gives its own smallest, at most ``entries``."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, vectors = _whole(batch.column(1), dims, scale)
            held += [(ids[r] is None, ids[r] or 0, v) for r, v in zip(rows.tolist(), vectors.tolist(), strict=True)]
            held = sorted(held)[:entries]
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.bool_()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.list_(pa.int64()))], ["none", "id", "vector"])

    found = df.mapInArrow(tidy(smallest), "none boolean, id long, vector array<long>").orderBy("none", "id", "vector").limit(entries)
    return np.array([r["vector"] for r in found.collect()], np.int64).reshape(-1, dims)


def _moved(df: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    parts, entries, width = books.entries.shape
    held = df.sparkSession.sparkContext.broadcast(books)
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        reach = 0
        for batch in batches:
            _, vectors = _whole(batch.column(1), own.dims, own.scale)
            reach += len(vectors) * int(np.abs(vectors).max(initial=0))
            if reach >= 1 << 63:
                raise OverflowError("the sum of an entry's components needs more than 63 bits")
            vectors = vectors.reshape(-1, parts, width)
            codes, _ = own.assign(vectors)
            for p in range(parts):
                np.add.at(totals[p], codes[:, p], vectors[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, counts[part, entry], *totals[part, entry].T)], ["part", "entry", "n", *names])

    schema = ", ".join(f"{c} long" for c in ("part", "entry", "n", *names))
    merged = df.mapInArrow(tidy(sums), schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names)))
    after = books.entries.copy()
    for r in merged.collect():  # parts x entries rows at most
        after[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    held.unpersist()
    return Codebooks(after, books.scale)


def train(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of the whole table; None if it has no vector that can be coded."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte for each part")
    small_batches(df.sparkSession, 4096)
    rows = _read(df, id_col, vector_col)
    lengths = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if lengths is None:
        return None
    dims = lengths["dims"]
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    start = _first(rows, dims, scale, entries)
    if not len(start):
        return None
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def encode(df: DataFrame, books: Codebooks | None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(all columns of df but the vector, code, error): a byte for each part, and the sum of the squared distances."""
    small_batches(df.sparkSession, 4096)
    others = [c for c in df.columns if c.lower() not in ("code", "error", vector_col.lower())]
    picked = df.select(*others, F.col(vector_col).cast("array<double>").alias(unused(df, "vector")[0]))
    schema = picked.select(*others, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).schema
    if books is None:
        return picked.select(*others, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    held = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        parts, _, width = own.entries.shape
        for batch in batches:
            rows, vectors = _whole(batch.column(batch.num_columns - 1), own.dims, own.scale)
            codes, away = own.assign(vectors.reshape(-1, parts, width))
            kept = [batch.column(i).take(pa.array(rows)) for i in range(batch.num_columns - 1)]
            code = [c.tobytes() for c in codes.astype(np.uint8)]
            total = away.sum(axis=1) if away.size == 0 or int(away.max()) < (1 << 63) // parts else [sum(a) for a in away.tolist()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(code, pa.binary()), pa.array(total, pa.int64())], [*others, "code", "error"])

    return picked.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, books: Codebooks, *, code_col: str = "code") -> DataFrame:
    """df with the approximate vector of each code, from its entries, in the place of ``vector``."""
    small_batches(df.sparkSession, 4096)
    held = df.sparkSession.sparkContext.broadcast(books.entries / books.scale)

    @F.pandas_udf("array<double>")
    def look(codes):
        own = held.value
        return codes.map(lambda c: None if c is None else own[np.arange(len(own)), np.frombuffer(c, np.uint8)].reshape(-1))

    return df.withColumn("vector", look(F.col(code_col)))


def _label_key(label: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit("null"))


def compress(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """(id, code in hex, error, label_error, codebooks_sha256) of every vector that can be coded. label_error
    sums the errors of one label; labels of very many rows are joined by broadcast, the rest by shuffle."""
    plain = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), _label_key(F.col(label_col)).alias("key"))
    books = train(plain, id_col="vec_id", vector_col="vector", **options)
    coded = materialise(encode(plain, books, id_col="vec_id", vector_col="vector"), "codes")
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"))
    digest = F.lit(books.digest() if books else "")
    return look_up(coded, sums, "key", coded.count()).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))

