"""Exact n-gram Jaccard join with vertical partitioning.

Two documents link when the sets of their word n-grams have a Jaccard similarity of at
least num / den. The work is cut along one global order of all n-grams: by how often an
n-gram's hash bucket was hit over all documents, then by hash.

1. One scan counts the buckets and gives every document its set size, its class (a hash
   of the whole set: copies become one class) and a 512-bit parity sketch of the set.
2. A second scan emits, for each class, the head of its set in the global order. Classes
   that link must share an n-gram of their heads. N-grams of one class only are dropped.
3. Candidates go in rounds. In a star round, every class that shares an n-gram is paired
   with the most central class that has it; links found then merge into components.
   The last round takes every pair of classes that share an n-gram of their heads and
   are not yet in one component. In every round sizes, positions and the sketches' distance
   (a lower bound of the sets' difference) rule out pairs that can't link. So no link between different
   components is lost, and groups of near copies are not spelt out into all their pairs.
4. The global order is cut into fragments. The overlap of a pair is counted in each
   fragment on its own and summed for each pair, so no task holds whole sets.

N-grams are 64-bit hashes. A class is named by the first half of a 128-bit hash of its set; where
sets that differ in the second half share the first (a few among 10**10 documents, collected), by
the second.

Defined cases. Null text is empty; documents without words have no n-grams, no links and
their own id as component; fewer words than an n-gram has count as one n-gram. Null ids
come last: a component has a null id only if all its ids are null. Repeated rows are
reported each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textops
from tagloom.llm.components import components
from tagloom.llm.joins import look_up, without_ids
from tagloom.llm.store import discard, finished, materialise, small_batches, tidy

WIDTH, NUM, DEN = 5, 80, 100
BUCKETS, PIECE = 1 << 20, 1 << 14
FRAGMENTS = 4
SPLIT = 1 << 16
BLOCK = 4096
STAR_ROUNDS = 2
ID_WORDS = 1 << 20


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    data, offsets = textops.text_buffers(batch.column(1))
    for a, b in textops.chunks(offsets):
        words, bounds = textops.hash_words(data, offsets[a : b + 1])
        yield from textops.shingle_sets(words, bounds, width)


def _names(grams: np.ndarray, size: int = 8) -> tuple[int, int]:
    """Two hashes of a set; size is the bytes of the first."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:size], "little", signed=size == 8), int.from_bytes(digest[8:], "little", signed=True)


def _class(grams: np.ndarray, shared: frozenset[int], size: int = 8) -> int:
    """The name of a set; shared are first hashes that several sets have."""
    first, second = _names(grams, size)
    return second if first in shared else first


def _sketch(grams: np.ndarray) -> bytes:
    return np.packbits(np.bincount((grams & np.uint64(511)).astype(np.int64), minlength=512) & 1).tobytes()


def _hits(sets: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)


def _profile(df: DataFrame, id_col: str, text_col: str, width: int, size: int) -> tuple[DataFrame, frozenset[int], np.ndarray, int]:
    """(doc_id, n, class, sketch) of every document; the first hashes that several sets have; the
    bucket counts; the number of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)

        def out(ids, sizes, names, sketches, pieces, blobs):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            columns = (ids, sizes, [a for a, _ in names], [b for _, b in names], sketches, pieces, blobs)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "class", "second", "sketch", "piece", "counts"])

        for batch in batches:
            sizes, classes, sketches, held, waiting = [], [], [], [], 0
            for grams in _sets(batch, width):
                held.append(grams)
                waiting += len(grams)
                if waiting > BUCKETS // 2:
                    counts += _hits(held)
                    held, waiting = [], 0
                sizes.append(len(grams))
                classes.append(_names(grams, size))
                sketches.append(_sketch(grams))
            if held:
                counts += _hits(held)
            none = [None] * len(sizes)
            yield out(batch.column(0), sizes, classes, sketches, none, none)
        if counts.any():
            blobs = [zlib.compress(counts[i : i + PIECE].astype("<i4").tobytes(), 1) for i in range(0, BUCKETS, PIECE)]
            none = [None] * len(blobs)
            yield out(none, none, [(None, None)] * len(blobs), none, list(range(len(blobs))), blobs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[piece] = held.get(piece, 0) + np.frombuffer(zlib.decompress(blob), "<i4").astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(np.minimum(v, 2**31 - 1).astype("<i4").tobytes(), 1) for v in held.values()], pa.binary())], ["piece", "counts"])

    schema = "doc_id long, n long, class long, second long, sketch binary, piece int, counts binary"
    seen = materialise(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), schema), "profile")
    parts = seen.where("piece is not null").select("piece", "counts").mapInArrow(tidy(add), "piece int, counts binary")
    total = np.zeros(BUCKETS, np.int64)
    for row in parts.repartition(BUCKETS // PIECE, "piece").mapInArrow(tidy(add), "piece int, counts binary").toLocalIterator():
        total[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] += np.frombuffer(zlib.decompress(row["counts"]), "<i4")
    found = seen.where("piece is null").drop("piece", "counts")
    alike = found.where("n > 0").groupBy("class").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high")
    shared = frozenset(r["class"] for r in alike.collect())  # of n sets about n * n / 2**65
    name = F.when(F.col("class").isin(list(shared)), F.col("second")).otherwise(F.col("class")) if shared else F.col("class")
    return found.withColumn("class", name).drop("second"), shared, total.astype(np.int32), int(total.sum())


def _ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of the global order: the bucket's count, then the hash's leading bits."""
    return counts[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | grams >> np.uint64(32)


def pivots(counts: np.ndarray, fragments: int) -> np.ndarray:
    """Keys that cut the global order into fragments with about as many occurrences each."""
    held = np.bincount(np.minimum(counts, 1 << 24), weights=counts)
    before = np.concatenate(([0.0], np.cumsum(held)))
    out = []
    for f in range(1, fragments):
        goal = before[-1] * f / fragments
        level = min(int(np.searchsorted(before, goal, "right")) - 1, len(held) - 1)
        share = (goal - before[level]) / held[level] if held[level] else 0.0
        out.append((level << 32) + min(int(share * 2**32), 2**32 - 1))
    return np.array(out, np.uint64)


def _heads(df: DataFrame, text_col: str, width: int, num: int, den: int, counts, parts: int, named) -> DataFrame:
    """(token, class, n, pos): the n-grams of classes' heads that at least two classes have."""
    shared = df.sparkSession.sparkContext.broadcast(counts)
    kind = np.dtype([("token", "<u8"), ("class", "<i8"), ("n", "<i4"), ("pos", "<i4")])

    def split(tokens: np.ndarray) -> np.ndarray:
        return 1 + shared.value[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)] // SPLIT

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for batch in batches:
            found = []
            for grams in _sets(batch, width):
                n = len(grams)
                if not n:
                    continue
                own = named(grams)
                if own in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen[own] = None
                head = n - -(-num * n // den) + 1
                picked = grams[np.argsort(_ranked(grams, shared.value), kind="stable")[:head]]
                rows = np.empty(head, kind)
                rows["token"], rows["class"], rows["n"], rows["pos"] = picked, own, n, np.arange(head)
                found.append(rows)
            if found:
                rows = np.concatenate(found)
                to = (rows["token"] >> np.uint64(24)) + (textops.mix(rows["class"].view(np.uint64) if rows["class"].flags.c_contiguous else np.ascontiguousarray(rows["class"]).view(np.uint64)) % split(rows["token"]).astype(np.uint64))
                to = (to % np.uint64(parts)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                cuts = np.flatnonzero(np.diff(to)) + 1
                firsts = np.concatenate(([0], cuts))
                yield pa.RecordBatch.from_arrays([pa.array(to[firsts], pa.int32()), pa.array([x.tobytes() for x in np.split(rows, cuts)], pa.binary())], ["part", "rows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [blob for batch in batches for blob in batch.column(1).to_pylist()]
        if not blobs:
            return
        rows = np.frombuffer(b"".join(blobs), kind)
        rows = rows[np.lexsort((rows["class"], rows["token"]))]
        token, own = rows["token"], rows["class"]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
        rows = rows[fresh]
        token = rows["token"]
        same = token[1:] == token[:-1]
        salted = split(token) > 1
        keep = salted.copy()
        keep[1:] |= same
        keep[:-1] |= same
        rows, salted = rows[keep], salted[keep]
        # of the classes that share an n-gram, those whose nearest sizes are too far link by no other either
        order = np.lexsort((rows["n"], rows["token"]))
        rows, salted = rows[order], salted[order]
        n = rows["n"].astype(np.int64)
        close = (rows["token"][1:] == rows["token"][:-1]) & (num * n[1:] <= den * n[:-1])
        keep = salted.copy()
        keep[1:] |= close
        keep[:-1] |= close
        rows = rows[keep]
        for i in range(0, len(rows), 1 << 16):
            part = rows[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c]).astype(np.int64) if c != "token" else np.ascontiguousarray(part[c]).view(np.int64), pa.int64()) for c in ("token", "class", "n", "pos")], ["token", "class", "n", "pos"])

    dealt = df.select(F.lit(0).alias("x"), F.col(text_col).cast("string")).mapInArrow(tidy(emit), "part int, rows binary").repartition(parts, "part")
    return dealt.mapInArrow(tidy(meet), "token long, class long, n long, pos long")


def _segments(df: DataFrame, id_col: str, text_col: str, width: int, needed: DataFrame, counts, cut: np.ndarray, named) -> DataFrame:
    """(class, fragment, grams) of the classes whose document's id is in needed, and of a few
    others; a class may come more than once."""
    h = F.xxhash64(F.col(id_col).cast("long"))
    bits = needed.select(F.xxhash64("doc_id").alias("h")).select(F.expr(f"pmod(h, {ID_WORDS})").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(ID_WORDS, np.uint64)
    for batch in bits.toArrow().to_batches():  # at most ID_WORDS rows of 16 bytes
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    held = df.sparkSession.sparkContext.broadcast((table, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = held.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            hit = table[np.mod(key, ID_WORDS)] >> (key.view(np.uint64) >> np.uint64(40) & np.uint64(63)) & np.uint64(1) != 0
            some = batch.filter(pa.array(hit))
            classes, fragments, grams = [], [], []
            for own in _sets(some, width):
                if not len(own):
                    continue
                name = named(own)
                where = np.searchsorted(cut, _ranked(own, counts), "right")
                for f in np.unique(where).tolist():
                    classes.append(name)
                    fragments.append(f)
                    grams.append(own[where == f].view(np.int64))
            if classes:
                ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(fragments, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))], ["class", "fragment", "grams"])

    return df.select(h.alias("h"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "class long, fragment int, grams array<long>")


def _possible(n: Column, m: Column, left: Column, num: int, den: int) -> Column:
    """Whether sets of sizes n and m may link when at most left of their n-grams are common."""
    return (num * F.greatest(n, m) <= den * F.least(n, m)) & (left * (num + den) >= num * (n + m))


def _close(n: np.ndarray, m: np.ndarray, one: np.ndarray, other: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes n and m may link by their sketches."""
    apart = np.bitwise_count(one ^ other).sum(1, dtype=np.int64)
    return (n + m - apart) // 2 * (num + den) >= num * (n + m)


def _near(pairs: DataFrame, profile: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that their sketches do not rule out."""
    of = lambda c: profile.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, 8) for i in (4, 5))
                yield batch.select(["a", "b"]).filter(pa.array(_close(n, m, one, other, num, den)))

    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return met.mapInArrow(tidy(run), "a long, b long")


def _star(rows: DataFrame, score: Column, num: int, den: int) -> DataFrame:
    """Pairs of each class with the first class by score that has the same n-gram."""
    hub = rows.groupBy("token").agg(F.max(F.struct(score.alias("score"), "class", "n", "pos", "comp")).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    met = rows.join(hub.select("token", "hub"), "token").where(F.col("comp") != F.col("hub.comp"))
    left = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("hub.n") - F.col("hub.pos") - 1)
    met = met.where(_possible(F.col("n"), F.col("hub.n"), left, num, den))
    return met.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()


def _rest(rows: DataFrame, profile: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Every pair of classes of different components that share an n-gram and may link."""
    many = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low <> high").select("token", F.expr(f"cast(ceil(m / {BLOCK}) as int)").alias("blocks"))
    met = rows.join(many, "token").join(profile.select("class", "sketch"), "class")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "n", "pos", "comp", "sketch")
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if found is None or not found.num_rows:
            return
        col = {c: found[c].to_numpy() for c in ("token", "i", "j", "own", "class", "n", "pos", "comp")}
        sketch = np.frombuffer(b"".join(found["sketch"].to_pylist()), np.uint64).reshape(-1, 8)
        order = np.lexsort((col["j"], col["i"], col["token"]))
        col = {c: v[order] for c, v in col.items()}
        sketch = sketch[order]
        group = np.cumsum(np.concatenate(([0], (np.diff(col["token"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0))))
        seen: list[np.ndarray] = []
        x = np.arange(len(group))
        for d in range(1, len(group)):
            x = x[: np.searchsorted(x, len(group) - d)]
            x = x[group[x] == group[x + d]]
            if not len(x):
                break
            y = x + d
            ok = (col["comp"][x] != col["comp"][y]) & ((col["i"][x] == col["j"][x]) | (col["own"][x] != col["own"][y]))
            n, m = col["n"][x], col["n"][y]
            ok &= num * np.maximum(n, m) <= den * np.minimum(n, m)
            left = 1 + np.minimum(n - col["pos"][x], m - col["pos"][y]) - 1
            ok &= left * (num + den) >= num * (n + m)
            p, q = x[ok], y[ok]
            if len(p):
                near = _close(col["n"][p], col["n"][q], sketch[p], sketch[q], num, den)
                p, q = col["class"][p[near]], col["class"][q[near]]
                seen.append(np.stack((np.minimum(p, q), np.maximum(p, q)), 1))
                if sum(map(len, seen)) > 1 << 20:
                    seen = [np.unique(np.concatenate(seen), axis=0)]
        if seen:
            pairs = np.unique(np.concatenate(seen), axis=0)
            for k in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 16), c]) for c in (0, 1)], ["a", "b"])

    return met.repartition(parts, "token", "i", "j").mapInArrow(tidy(run), schema).distinct()


def _verified(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link: overlaps counted in each fragment, summed for each pair."""
    of = lambda c: segments.select(F.col("class").alias(c), "fragment", F.col("grams").alias(f"of_{c}"))
    wide = pairs.withColumn("fragment", F.explode(F.array(*(F.lit(f) for f in range(FRAGMENTS)))))
    parts = wide.join(of("b"), ["b", "fragment"]).join(of("a"), ["a", "fragment"])
    each = parts.groupBy("a", "b", "fragment").agg(F.max(F.size(F.array_intersect("of_a", "of_b"))).alias("both"))
    total = each.groupBy("a", "b").agg(F.sum("both").alias("both"))
    n = lambda c: sizes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"))
    held = total.join(n("a"), "a").join(n("b"), "b")
    return held.where(F.col("both") * (num + den) >= num * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def link(df: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) of every row of df, as a written table."""
    return finished(lambda: _link(df, **options), "linked")


def _link(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, name_bytes: int = 8) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    profile, shared, counts, total = _profile(df, id_col, text_col, width, name_bytes)
    name_of = partial(_class, shared=shared, size=name_bytes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * (den - num) // den // 1_000_000))
    classes = materialise(profile.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    heads = materialise(_heads(df, text_col, width, num, den, counts, parts, name_of), "heads")
    share = heads.groupBy("class").agg((F.count("*") / F.first("n")).alias("share"))
    links, labels, cut = None, None, pivots(counts, FRAGMENTS)
    for turn in range(STAR_ROUNDS + 1):
        rows = heads.withColumn("comp", F.col("class")) if labels is None else heads.join(labels.withColumnsRenamed({"node": "class"}), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        if turn == STAR_ROUNDS:
            pairs = _rest(rows, classes, num, den, parts)
        elif turn == 0:
            pairs = _near(_star(rows.join(share, "class"), F.col("share"), num, den), classes, num, den)
        else:
            pairs = _near(_star(rows, F.xxhash64("class", F.lit(turn)), num, den), classes, num, den)
        pairs = materialise(pairs, "pairs")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "doc_id"), "class")
        segments = materialise(_segments(df, id_col, text_col, width, asked.select("doc_id"), counts, cut, name_of), "segments")
        found = materialise(_verified(pairs, segments, classes, num, den), "found")
        discard(segments)
        discard(pairs)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
    rows = profile.count()
    if labels is None:
        named = classes.select("class", "doc_id")
    else:
        at = classes.join(labels.withColumnsRenamed({"node": "class"}), "class", "left").withColumn("comp", F.coalesce("comp", "class")).select("class", "doc_id", "comp")
        least = at.groupBy("comp").agg(F.min("doc_id").alias("least"))
        named = look_up(at.select("class", "comp"), least, "comp", rows).select("class", F.col("least").alias("doc_id"))
    named = materialise(named.withColumnRenamed("doc_id", "least"), "components")
    discard(heads)
    full = look_up(profile.where("n > 0").select("doc_id", "n", "class"), named, "class", rows).select("doc_id", "n", F.col("least").alias("component_id"), "class")
    bare = profile.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class"))
    return full.unionByName(bare).withColumnRenamed("n", "n_shingles")


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the documents that are not the first of their component. Rows without an
    id stay."""
    linked = link(df, id_col=id_col, text_col=text_col, **options)
    gone = materialise(linked.where("doc_id <> component_id").select("doc_id"), "gone")
    return without_ids(df, gone, id_col)
