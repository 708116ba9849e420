"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet in the shared folder and hands it to the next; what a stage wrote on its way, and
its predecessor's result, are deleted then. Each stage first has the executors give back
the heap that they don't use. All stages but the last keep the columns of documents.

Rows and columns. Null texts count as empty, extra columns stay, and repeated rows are one
document to the dedup stages. The n-gram Jaccard join decides by doc_id and keeps rows without
one; all other stages decide by row. An empty table passes through empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import decontaminate, exact_dedup, jaccard, packing, quality
from tagloom.llm.queries import tokenizer_path
from tagloom.llm.store import discard, finished, give_back_heaps


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that begins with the heaps that its predecessors have grown on the same executors given back."""

    @wraps(make)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        return make(spark, docs, sf_dir)

    return begun


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.keep(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


@_stage
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.dedup(docs)


@_stage
def distinct_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.dedup(docs, width=5, num=80, den=100)


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer_path("words"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_sets),
    ("benchmark decontamination", without_benchmark),
    ("packing", sequences),
]

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            discard(written)
        written = docs
    return docs
