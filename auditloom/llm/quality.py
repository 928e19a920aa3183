"""Quality classifier by compression: zstandard dictionaries of good and of bad texts.

A text is compressed in blocks with either dictionary. The difference of the two sizes,
divided by the text's own size, says which kind of text it is more like (text that
repeats itself is small with both, so it has no good difference either). A logistic
curve, fitted on labelled texts that the dictionaries have not seen and set to the share
of good labels, makes it the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Cut, in_blocks, small_batches, texts

#: Bytes compressed at a time, bytes of a dictionary, and the compression level.
CHUNK, DICT_BYTES, LEVEL = 1024, 112 << 10, 3
#: Bytes of evidence that a text's difference starts with, of the average kind: a few words decide nothing.
PRIOR_BYTES = 96


@dataclass
class CompressionModel:
    good: tuple[bytes, bool]
    bad: tuple[bytes, bool]
    mean: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    fitted: bool = False


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def _dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or with too few samples their plain content; and whether it is the latter."""
    pieces = [p for x in samples for p in _pieces(x)]
    try:
        size = min(DICT_BYTES, sum(map(len, pieces)) // 4)
        return zstandard.train_dictionary(size, pieces).as_bytes(), False
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICT_BYTES] or b"\n" * 8, True


class _Sizer:
    def __init__(self, dictionary: tuple[bytes, bool]):
        content, raw = dictionary
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=d).compress

    def __call__(self, pieces: list[bytes]) -> int:
        compress = self.compress
        return sum(len(compress(p)) for p in pieces)


def _differences(model: CompressionModel, docs: list[bytes]) -> np.ndarray:
    good, bad = _Sizer(model.good), _Sizer(model.bad)
    out = np.empty(len(docs))
    for i, x in enumerate(docs):
        p = _pieces(x)
        out[i] = (bad(p) - good(p) + PRIOR_BYTES * model.mean) / (len(x) + PRIOR_BYTES)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method on the standardised values."""
    mean, sd = x.mean(), x.std() or 1.0
    z, b = np.stack([(x - mean) / sd, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), grad)
        b -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return b[0] / sd, b[1] - b[0] * mean / sd


def train_model(documents: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = 1500, sample_chars: int = 65_536, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> CompressionModel:
    """Fit on a bounded sample: ``per_class`` labelled texts of either class.

    Labelled texts of over ``sample_chars`` characters are left out of it, not cut. The
    sample is the first by a hash of the id among the rows that ``usable`` admits; three
    fifths make the dictionaries and the rest the curve. Ids with both labels, and null
    labels, ids or texts, are not used; an id on several rows counts once, with its text of
    the least hash. Without texts of either class the score is the smoothed share of label
    1 among the labels, which is 0.5 without any.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("top"))
    known = known.filter(F.col("y") == F.col("top")).select("id", "y")
    if usable is not None:
        known = known.filter(usable)
    usable_docs = documents.filter(F.length(text) <= sample_chars).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # Ids, labels and hashes of the labelled texts are written once; counts and the sample come from there.
    there = Cut(usable_docs.select("id").join(known, "id").groupBy("id").agg(F.min("y").alias("y")).select("id", "y", F.xxhash64("id").alias("h")))
    counts = {r["y"]: r["n"] for r in there.df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    model = CompressionModel((b"\n" * 8, True), (b"\n" * 8, True), offset=float(np.log(prior / (1 - prior))))
    if not counts.get(0) or not counts.get(1):
        there.drop()
        return model
    chosen = there.df.filter("y = 0").orderBy("h", "id").limit(per_class).unionByName(there.df.filter("y = 1").orderBy("h", "id").limit(per_class))
    # One text an id, so what comes to the driver is per_class * sample_chars a class at most.
    rows = usable_docs.join(F.broadcast(chosen), "id").groupBy("id", "y", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    there.drop()
    by = {y: [r["text"].encode() for r in sorted(rows, key=lambda r: (r["h"], r["id"])) if r["y"] == y] for y in (0, 1)}
    split = {y: max(1, len(x) * 3 // 5) for y, x in by.items()}
    model.good, model.bad = _dictionary(by[1][: split[1]]), _dictionary(by[0][: split[0]])
    rest = {y: by[y][split[y] :] or by[y] for y in (0, 1)}
    diffs = {y: _differences(model, rest[y]) for y in (0, 1)}
    lengths = {y: np.array([len(t) for t in rest[y]]) for y in (0, 1)}
    model.mean = float(prior * diffs[1].mean() + (1 - prior) * diffs[0].mean())
    x = np.concatenate([diffs[y] + PRIOR_BYTES * model.mean / (lengths[y] + PRIOR_BYTES) for y in (0, 1)])
    y = np.concatenate([np.zeros(len(diffs[0])), np.ones(len(diffs[1]))])
    weight = np.where(y == 1, prior / len(diffs[1]), (1 - prior) / len(diffs[0])) * len(y)
    model.slope, model.offset = map(float, _logistic(x, y, weight))
    model.fitted = True
    return model


def score_quality(documents: DataFrame, model: CompressionModel, into: str = "quality_score", text: str = "text") -> DataFrame:
    """The documents with their score, 0 to 1, in column ``into``, which is replaced if it exists.

    Only the text is read; null scores as the empty text does, with the average evidence.
    Long texts are compressed whole, block by block. No row is added, dropped or moved.
    """
    small_batches(documents.sparkSession)
    columns = [f for f in documents.schema.fields if f.name != into]
    schema = T.StructType([*columns, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, text):
            z = model.slope * _differences(model, texts(batch, text)) + model.offset
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, into])

    return documents.select(*[F.col(f"`{f.name}`") for f in columns]).mapInArrow(run, schema)
