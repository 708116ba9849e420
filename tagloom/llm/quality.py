"""Quality classifier by compression with dictionaries of good and of bad text.

From a bounded sample of labelled texts (see labelled.sample: at most 3,000 rows and 12 MiB
for each label), one half trains a Zstandard dictionary for each label. Every text is then
compressed whole with either dictionary and with none; the difference of the sizes,
divided by their sum, with the compression ratio beside it, becomes a probability by a
logistic calibration fitted on the sample's other half, weighted to the labels' true shares.

Defined cases. Null text is empty; empty texts get a score like any other. Without
labelled rows of both kinds every score is the share of label 1 (0.5 without any label).
Null ids are never learnt from nor held out. Repeated rows are scored each. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.labelled import Calibration, held_out, sample
from tagloom.llm.store import small_batches, tidy

DICTIONARY, LEVEL, CUTOFF, FOLDS = 112 << 10, 3, 0.3, 5


def dictionary(texts: list[bytes], size: int = DICTIONARY):
    """A trained dictionary, or the texts themselves as one if they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, texts, level=LEVEL)
    except z.ZstdError:
        return z.ZstdCompressionDict(b"".join(texts)[-size:] or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)


class Features:
    def __init__(self, good: bytes, bad: bytes, raw: tuple[bool, bool] = (False, False)):
        import zstandard as z

        kinds = [z.DICT_TYPE_RAWCONTENT if r else z.DICT_TYPE_AUTO for r in raw]
        made = [z.ZstdCompressionDict(d, dict_type=k) for d, k in zip((good, bad), kinds, strict=True)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.coders = [*(z.ZstdCompressor(dict_data=d, **options) for d in made), z.ZstdCompressor(**options)]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        good, bad, none = (np.array([len(c.compress(t)) for t in texts], float) for c in self.coders)
        size = np.array([len(t) for t in texts], float)
        return np.column_stack([(bad - good) / (bad + good), np.log((none + 8) / (size + 8)), np.log(size + 8), np.log((good + 8) / (none + 8))])


class Model:
    """Plain data that a task turns into a scorer."""

    def __init__(self, texts: dict[int, list[str]], counts: dict[int, int]):
        total = counts[0] + counts[1]
        self.share = counts[1] / total if total else 0.5
        self.calibration = None
        raw = {y: [t.encode() for t in v] for y, v in texts.items()}
        if min(len(raw[0]), len(raw[1])) < 2:
            return
        good, bad = dictionary(raw[1][::2]), dictionary(raw[0][::2])
        self.dictionaries = good.as_bytes(), bad.as_bytes()
        self.raw = tuple(d.dict_id() == 0 for d in (good, bad))
        own = self.features()
        rest = {y: v[1::2] for y, v in raw.items()}
        y = np.concatenate([np.full(len(rest[k]), k, float) for k in (0, 1)])
        weight = np.where(y == 1, counts[1] / len(rest[1]), counts[0] / len(rest[0]))
        self.calibration = Calibration(own(rest[0] + rest[1]), y, weight / weight.mean())

    def features(self) -> Features:
        return Features(*self.dictionaries, self.raw)


def train(df: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    return Model(*sample(df, labels, label_col, id_col=id_col, text_col=text_col, folds=FOLDS, **options))


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        features = own.features() if own.calibration else None
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            p = own.calibration(features(texts)) if features and texts else np.full(len(texts), own.share)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= cutoff).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), FOLDS).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep(df: DataFrame, model: Model, *, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of df, with all their columns, whose score is at least cutoff."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        features = own.features() if own.calibration else None
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(place)]
            p = own.calibration(features(texts)) if features and texts else np.full(len(texts), own.share)
            yield batch.filter(pa.array(p >= cutoff))

    return df.mapInArrow(tidy(run), df.schema)
