"""Token ids in files of fixed-width packed bits, with block offsets for random access.

Every id takes the minimum number of bits that holds the vocabulary. A shard is

    "TLBITS01" | blocks | table | footer

A block holds up to 65,536 ids, packed little-endian in whole groups of 64 ids, so that
64 ids of b bits are exactly b 64-bit words and packing and unpacking run lane by lane in
numpy. The table is four little-endian arrays: block offsets (bytes, u64, one more
than blocks), document ids (i64), whether each id is present (u1), token starts (u64, one
more than documents). The footer is six u64: bits, ids, blocks, documents, position of
the table, and the magic number again.

Shards follow the order of document ids. A task writes its shard under a name of its own
and reports it; only reported shards are in the manifest, so a repeated task leaves at
most an unreferenced file. The manifest has one row for each shard.

Defined cases. A null or empty text is its end id alone. Null ids come first (ids are above
-2**63) and are read back as null. Rows that repeat are stored each, equal ids ordered by their text's hash. An
empty table gives no shard and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.store import filesystem, make_dir, small_batches, tidy
from tagloom.llm.tokenise import read_file, shared

MAGIC = b"TLBITS01"
BLOCK, SAMPLE = 1 << 16, 200
MANIFEST = "shard string, part long, docs long, tokens long, bytes long"


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Whole groups of 64 ids, the last filled up with zeros."""
    if bits == 16:
        padded = np.zeros(-(-len(ids) // 64) * 64, "<u2")
        padded[: len(ids)] = ids
        return padded.tobytes()
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= groups[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= groups[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2")[:count].astype(np.uint32)
    words = np.frombuffer(data, "<u8").astype(np.uint64).reshape(-1, bits)
    groups = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        groups[:, lane] = value & mask
    return groups.reshape(-1)[:count]


class ShardWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.offsets, self.keys, self.present, self.starts = [len(MAGIC)], [], [], [0]
        self.waiting, self.held, self.total = [], 0, 0
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.present.append(key is not None)
        self.total += len(ids)
        self.starts.append(self.total)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            every = np.concatenate(self.waiting)
            full = len(every) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                self._block(every[i : i + BLOCK])
            self.waiting, self.held = [every[full:].copy()], len(every) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> int:
        if self.held:
            self._block(np.concatenate(self.waiting))
        table = b"".join((np.array(self.offsets, "<u8").tobytes(), np.array(self.keys, "<i8").tobytes(), np.array(self.present, "u1").tobytes(), np.array(self.starts, "<u8").tobytes()))
        magic = int.from_bytes(MAGIC, "little")
        footer = np.array([self.bits, self.total, len(self.offsets) - 1, len(self.keys), self.offsets[-1], magic], "<u8").tobytes()
        self.out.write(table + footer)
        return self.offsets[-1] + len(table) + len(footer)


class Shard:
    """Random access to the ids of one shard."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        foot = np.frombuffer(file.read_at(48, size - 48), "<u8").tolist()
        self.bits, self.tokens, blocks, docs, at, magic = foot
        if magic != int.from_bytes(MAGIC, "little"):
            raise ValueError("not a token shard")
        table = file.read_at(size - 48 - at, at)
        a, b, c = (blocks + 1) * 8, docs * 8, docs
        self.offsets = np.frombuffer(table[:a], "<u8")
        self.keys = np.frombuffer(table[a : a + b], "<i8")
        self.present = np.frombuffer(table[a + b : a + b + c], "u1").astype(bool)
        self.starts = np.frombuffer(table[a + b + c :], "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, by their place in the shard; only their blocks are read."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        found = unpack_bits(data, self.bits, min((last + 1) * BLOCK, self.tokens) - first * BLOCK)
        return found[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, window: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, place of the first token, ids) of every document, reading about window ids at once."""
        n, i = len(self.keys), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + window, "right")) - 1)
            held = self.ids(int(self.starts[i]), int(self.starts[j]))
            for d in range(i, j):
                lo, hi = int(self.starts[d] - self.starts[i]), int(self.starts[d + 1] - self.starts[i])
                yield (int(self.keys[d]) if self.present[d] else None), int(self.starts[d]), held[lo:hi]
            i = j


def _bounds(df: DataFrame, parts: int) -> np.ndarray:
    """parts - 1 ids that cut the ids of df into ranges of about as many rows, from a sample of
    about SAMPLE ids for each range (or all). A null counts as the smallest id."""
    rows = df.count()
    few = df if rows <= SAMPLE * parts else df.sample(SAMPLE * parts / rows, 17)
    found = np.sort(few.select(F.coalesce("k", F.lit(-(1 << 63))).alias("k")).toArrow()["k"].to_numpy())
    return found[np.arange(1, parts) * len(found) // parts] if len(found) else found


def _range_of(keys: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each id. An id that is a bound has all ranges beside it, in the order of the ties."""
    first, last = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    share = (ties.astype(np.float64) + 2.0**63) / 2.0**64
    return (first + np.minimum(share * (last - first + 1), last - first).astype(np.int64)).astype(np.int32)


def write_tokens(df: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, plain: bool = False) -> list[dict]:
    """Encode df into shards below folder, in ascending order of id; the manifest, in order.
    Strings of special tokens become their ids unless ``plain``.

    Texts are encoded where they lie, and ids of two or four bytes are dealt by ranges of (id,
    hash of text), so one id that many rows share is spread too, and a lost shard encodes nothing again.
    There are as many shards as df has partitions, or shuffle partitions if these are more."""
    spark = df.sparkSession
    small_batches(spark)
    make_dir(spark, folder)
    file = spark.sparkContext.broadcast(read_file(tokenizer))  # a few MB
    key, text = F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")
    picked = df.select(key, F.xxhash64(text).alias("h"), text)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), picked.rdd.getNumPartitions())
    bounds = _bounds(df.select(key), parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(file.value, plain)
        for batch in batches:
            keys, ties = batch.column(0).fill_null(-(1 << 63)).to_numpy(), batch.column(1).to_numpy()
            ids = [x.tobytes() for x in encoder.many(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(_range_of(keys, ties, bounds)), batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["part", "k", "h", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = shared(file.value, plain), None, TaskContext.get().partitionId()
        bits = bits_for(max(encoder.vocab, end_id + 1))
        end = np.array([end_id], np.uint32)
        shard = f"part-{part:08d}-{uuid.uuid4().hex}.bits"
        fs, root = filesystem(folder)
        out = None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    out = fs.open_output_stream(f"{root}/{shard}")
                    writer = ShardWriter(out, bits)
                writer.add(key, np.concatenate((np.frombuffer(ids.as_buffer(), encoder.dtype), end)))
        if writer is not None:
            size = writer.close()
            out.close()
            row = [[shard], [part], [len(writer.keys)], [writer.total], [size]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["shard", "part", "docs", "tokens", "bytes"])

    encoded = picked.mapInArrow(tidy(encode, encodes=True), "part int, k long, h long, ids binary")
    dealt = encoded.repartitionById(parts, "part").sortWithinPartitions("k", "h", "ids").select("k", "ids")
    rows = dealt.mapInArrow(tidy(run, encodes=True), MANIFEST).collect()  # one row for each task
    return [r.asDict() for r in sorted(rows, key=lambda r: r["part"])]


def read_tokens(spark: SparkSession, folder: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files."""
    rows, before = [], 0
    for m in manifest:
        rows.append((m["shard"], before))
        before += m["tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)

        def out(held: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    held = []
                    for key, start, ids in Shard(file).documents():
                        held.append((key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype("i4")))
                        if len(held) == 256:
                            yield out(held)
                            held = []
                    if held:
                        yield out(held)

    shards = spark.createDataFrame(rows, "shard string, base long").repartition(max(1, len(rows)))
    return shards.mapInArrow(tidy(run), schema)
