"""A bounded, repeatable sample of labelled texts, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_BYTES = 3000, 12 << 20


def remainder(id_column: Column, by: int) -> Column:
    """crc32 of the id written as text, modulo by; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % by


def held_out(id_column: Column, by: int) -> Column:
    return F.coalesce(remainder(id_column, by) == 0, F.lit(False))


def sample(df: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[dict[int, list[str]], dict[int, int]]:
    """For labels 0 and 1: whole training texts, and how many labelled training ids there are.

    For each label the ids with the smallest hashes are taken, at most ``rows``, and of
    their texts, in that order, the first that fit into ``size`` bytes in all (at least one).
    Of an id's several texts, that with the smallest hash counts, once. Rows whose id's crc32 modulo folds is 0, null labels and null ids are never learnt from.
    """
    known = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and k is not null").where(remainder(F.col("k"), folds) != 0)
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    counts = {0: 0, 1: 0} | {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    first = [known.where(F.col("y") == y).select("k", "y", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(rows) for y in (0, 1)]
    picked = F.broadcast(first[0].unionByName(first[1]))
    texts = df.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(picked, "k")
    least = texts.groupBy("y", "h", "k").agg(F.min(F.struct(F.xxhash64("t").alias("x"), F.octet_length("t").alias("n"))).alias("m"))
    sizes = sorted((r["y"], r["h"], r["k"], r["n"], r["x"]) for r in least.select("y", "h", "k", "m.n", "m.x").collect())  # a row for each of at most 2 * rows ids
    room, chosen = {0: size, 1: size}, []
    for y, h, k, n, x in sizes:
        if n <= room[y] or room[y] == size:
            room[y] -= n
            chosen.append((k, x))
    wanted = df.sparkSession.createDataFrame(chosen, "k long, x long") if chosen else None
    out: dict[int, list[tuple[int, str]]] = {0: [], 1: []}
    if wanted is not None:
        found = texts.withColumn("x", F.xxhash64("t")).join(F.broadcast(wanted), ["k", "x"])
        for r in found.groupBy("y", "h", "k").agg(F.min("t").alias("t")).toLocalIterator():
            out[r["y"]].append((r["h"], r["t"]))
    return {y: [t for _, t in sorted(v)] for y, v in out.items()}, counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column is constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1]) * weight.sum()
    penalty[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Calibration:
    """Features to a probability: scaled features, their squares and products, logistic."""

    def __init__(self, features: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.scale = features.mean(0), np.maximum(features.std(0), 1e-9)
        self.w = logistic(self._wide(features), y, weight)

    def _wide(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -8, 8)
        k = z.shape[1]
        return np.column_stack([np.ones(len(z)), z, *(z[:, i] * z[:, j] for i in range(k) for j in range(i, k))])

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._wide(features) @ self.w, -30, 30)))
