"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.sampling import fold, labelled_sample
from siftlake.llm.words import map_texts, pieces

# Texts of either class that the classifier is fitted on, at most.
SAMPLE_ROWS = 2000
ORDERS = (3, 4, 5)
BITS = 20
# Features kept for fitting, at most, and by how many standard errors the classes must differ on them.
KEPT = 1 << 16
CERTAINTY = 3.5
ROUNDS = 60
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


class _Distinct:
    """Drops repeats from an index array in linear time, without sorting."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        places = np.arange(len(values))
        self.last[values] = places
        return values[self.last[values] == places]


def ngram_features(text: str | None, distinct: _Distinct) -> np.ndarray:
    """The distinct hashed character n-grams of a lower-cased text, with a space at either end."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for order in ORDERS:
        count = len(points) - order + 1
        if count <= 0:
            continue
        total = np.full(count, order * 0x9E3779B9 & 0xFFFFFFFF, np.uint32)
        for at in range(order):
            total = (total ^ points[at : at + count]) * _FACTORS[at]
            total ^= total >> np.uint32(15)
        found.append(total >> np.uint32(32 - BITS))
    return distinct(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    distinct = _Distinct()
    for piece in pieces(batches):
        found = [ngram_features(text, distinct) for text in piece.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([lists, piece.column("label")], ["features", "label"])


def fit_weights(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over all hashed n-grams and an intercept, from the distinct features of each text.

    With p and q the smoothed shares of positive and negative texts that hold an n-gram, its
    feature is r = log(p / q) where present. Logistic regression with an L2 penalty is fitted on the
    scaled features by Adam; the result folds r into the weights.
    """
    size = 1 << BITS
    weights = np.zeros(size)
    positive, negative = int(labels.sum()), int(len(labels) - labels.sum())
    if not positive or not negative:
        return weights, -20.0 if not positive else 20.0
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_one = labels[owner] == 1
    ones = np.bincount(flat[is_one], minlength=size)
    zeros = np.bincount(flat[~is_one], minlength=size)
    ratio = np.log((ones + 1) / (positive + 2)) - np.log((zeros + 1) / (negative + 2))
    # How many standard errors the log ratio is from 0; chance features of a small sample are left out.
    certainty = np.abs(ratio) / np.sqrt(1 / (ones + 1) + 1 / (zeros + 1))
    kept = np.flatnonzero(certainty >= CERTAINTY)
    kept = np.sort(kept[np.argsort(-certainty[kept], kind="stable")[:KEPT]])
    width = len(kept)
    place = np.full(size, -1)
    place[kept] = np.arange(width)
    inside = place[flat] >= 0
    column, owner = place[flat][inside], owner[inside]
    scale = ratio[kept]
    value = scale[column]
    target = labels.astype(float)
    own, intercept = np.zeros(width), 0.0
    first, second, first_b, second_b = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        margin = intercept + np.bincount(owner, own[column] * value, len(rows))
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        gradient = np.bincount(column, error[owner] * value, width) / len(rows) + 1e-4 * own
        gradient_b = error.mean()
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        first_b, second_b = 0.9 * first_b + 0.1 * gradient_b, 0.999 * second_b + 0.001 * gradient_b**2
        bias_1, bias_2 = 1 - 0.9**step, 1 - 0.999**step
        own -= 0.02 * (first / bias_1) / (np.sqrt(second / bias_2) + 1e-8)
        intercept -= 0.02 * (first_b / bias_1) / (np.sqrt(second_b / bias_2) + 1e-8)
    weights[kept] = own * scale
    return weights, float(intercept)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        for features, label in zip(batch.column("features"), batch.column("label").to_pylist()):
            rows.append(features.values.to_numpy(zero_copy_only=False).copy())
            labels.append(label)
    weights, intercept = fit_weights(rows, np.array(labels, int))
    columns = [pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([intercept]), pa.array([sum(labels) / max(1, len(labels))])]
    yield pa.RecordBatch.from_arrays(columns, ["weights", "intercept", "share"])


def train(docs: DataFrame, labels: DataFrame, label: str, usable, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample_rows`` texts of either class; the model has a fixed size of 4 MB.

    N-grams are extracted where the texts lie; one task fits the bounded sample. The
    intercept is moved from the sample's share of class 1 to that among all usable labels.
    """
    sample, share = labelled_sample(docs, labels, label, usable, sample_rows)
    features = sample.mapInArrow(_features, "features array<int>, label int")
    # Sorted, so that a rerun adds up the same numbers in the same order.
    features = features.repartition(1).sortWithinPartitions("label", F.xxhash64("features"))
    row = features.mapInArrow(_fit, "weights binary, intercept double, share double").first()
    if row is None:
        return np.zeros(1 << BITS, np.float32), -20.0
    weights, intercept = np.frombuffer(row["weights"], "<f4"), row["intercept"]
    if 0 < share < 1 and 0 < row["share"] < 1:
        intercept += float(np.log(share / (1 - share)) - np.log(row["share"] / (1 - row["share"])))
    return weights, intercept


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Score every whole text: the columns ``keep`` (default: all) and the score, from 0 to 1, as ``name``.

    Only the text enters a score. NULL counts as empty; an empty text has the score of a text
    without known n-grams. Labels may cover ids that are missing or repeated; labels other than 0
    and 1 are ignored, and without labels of both classes every score is near 0 (or near 1 if all are 1).
    """
    usable = F.coalesce(fold("doc_id", 5), F.lit(0)) != 0
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "toxic", usable))

    def scores(texts: pa.Array) -> list[pa.Array]:
        weights, intercept = model.value
        distinct = _Distinct()
        margins = [float(weights[ngram_features(text, distinct)].sum(dtype=np.float64)) for text in texts.to_pylist()]
        return [pa.array(1 / (1 + np.exp(-np.clip(np.array(margins) + intercept, -30, 30))))]

    return map_texts(docs, scores, [T.StructField(name, T.DoubleType())], keep)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = toxicity(docs, labels, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
