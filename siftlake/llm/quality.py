"""Text quality by a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.sampling import fold, labelled_sample
from siftlake.llm.words import map_texts, pieces, split_words, text_bytes

SAMPLE_ROWS = 2000
BITS = 16
RANK = 8
ROUNDS = 80
BATCH = 256

# Bytes counted for the structure of a text.
_KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "break": [10, 13],
    "space": [9, 11, 12, 32],
    "end": [33, 46, 63],
    "comma": [39, 44, 45, 58, 59],
    "sign": [*range(35, 39), 40, 41, 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)],
    "wide": range(128, 256),
}
_KIND_TABLE = np.zeros((256, len(_KINDS)))
for _at, _bytes in enumerate(_KINDS.values()):
    _KIND_TABLE[list(_bytes), _at] = 1
# Every statistic is cut into so many bins, each a feature of its own.
BINS = 12
STATISTICS = len(_KINDS) + 6
FEATURES = (1 << BITS) + STATISTICS * BINS


def _statistics(data: np.ndarray, lengths: np.ndarray, distinct: int) -> np.ndarray:
    """Numbers from 0 to 1 about a text's structure; ``lengths`` are those of its words in bytes."""
    size, count = max(1, len(data)), max(1, len(lengths))
    kinds = np.bincount(data, minlength=256) @ _KIND_TABLE
    top = np.bincount(data[data > 32], minlength=256).max(initial=0)
    rest = [
        np.log1p(len(data)) / 16,
        np.log1p(len(lengths)) / 14,
        min(1.0, lengths.mean() / 16 if len(lengths) else 0.0),
        min(1.0, lengths.std() / 10 if len(lengths) else 0.0),
        distinct / count,
        top / size * 4,
    ]
    return np.sqrt(np.clip(np.concatenate([kinds / size, np.square(np.clip(rest, 0, 1))]), 0, 1))


def features_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text's features: words by log count, and one bin per statistic."""
    found = split_words(texts, lower=True)
    hashed = (found.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    data, offsets = text_bytes(texts)
    lengths = found.ends - found.starts
    rows = []
    for at, (start, end) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
        words, counts = np.unique(hashed[start:end], return_counts=True)
        numbers = _statistics(data[offsets[at] : offsets[at + 1]], lengths[start:end], len(words))
        bins = np.minimum((numbers * BINS).astype(np.int64), BINS - 1)
        values = np.log1p(counts)
        values = values / max(1e-9, np.sqrt(np.square(values).sum()))
        own = (1 << BITS) + np.arange(STATISTICS) * BINS + bins
        rows.append((np.concatenate([words, own]), np.concatenate([values, np.full(STATISTICS, STATISTICS**-0.5)])))
    return rows


def interactions(factors: np.ndarray, values: np.ndarray) -> float:
    """All pairwise interactions in linear time: half the square of sums less the sum of squares."""
    scaled = factors * values[:, None]
    return 0.5 * float((np.square(scaled.sum(axis=0)) - np.square(scaled).sum(axis=0)).sum())


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and, per feature, its weight and factors, by Adagrad on the logistic loss.

    Batches are drawn by a fixed seed; both classes weigh the same.
    """
    table = np.zeros((FEATURES, RANK + 1))
    ones = int(labels.sum())
    if not ones or ones == len(labels):
        return (20.0 if ones or not len(labels) else -20.0), table
    random = np.random.default_rng(0)
    table[:, 1:] = random.normal(0, 0.05, (FEATURES, RANK))
    intercept, grown, grown_b = 0.0, np.full((FEATURES, RANK + 1), 1e-2), 1e-2
    weight = np.where(labels == 1, 0.5 * len(labels) / ones, 0.5 * len(labels) / (len(labels) - ones))
    for _ in range(ROUNDS):
        order = random.permutation(len(rows))
        for chosen in np.split(order, range(BATCH, len(order), BATCH)):
            columns = np.concatenate([rows[at][0] for at in chosen])
            values = np.concatenate([rows[at][1] for at in chosen])
            firsts = np.concatenate([[0], np.cumsum([len(rows[at][0]) for at in chosen])])
            owner = np.repeat(np.arange(len(chosen)), np.diff(firsts))
            scaled = table[columns] * values[:, None]
            sums = np.add.reduceat(scaled, firsts[:-1])
            squares = np.add.reduceat(np.square(scaled[:, 1:]), firsts[:-1])
            margin = intercept + sums[:, 0] + 0.5 * (np.square(sums[:, 1:]) - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) * weight[chosen] / len(chosen)
            slope = np.ones_like(scaled)
            slope[:, 1:] = sums[owner, 1:] - scaled[:, 1:]
            slope *= (error[owner] * values)[:, None]
            used, which = np.unique(columns, return_inverse=True)
            gradient = np.stack([np.bincount(which, slope[:, at], len(used)) for at in range(RANK + 1)], axis=1)
            gradient += 1e-4 * table[used]
            grown[used] += np.square(gradient)
            table[used] -= 0.1 * gradient / np.sqrt(grown[used])
            grown_b += error.sum() ** 2
            intercept -= 0.1 * error.sum() / np.sqrt(grown_b)
    return float(intercept), table


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        rows = features_of(piece.column("text"))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
        columns = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[0] for r in rows]).astype(np.int32)))
        values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[1] for r in rows])))
        yield pa.RecordBatch.from_arrays([columns, values, piece.column("label")], ["columns", "values", "label"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        for columns, values, label in zip(batch.column("columns"), batch.column("values"), batch.column("label").to_pylist()):
            rows.append((columns.values.to_numpy(zero_copy_only=False).copy(), values.values.to_numpy(zero_copy_only=False).copy()))
            labels.append(label)
    intercept, table = fit_machine(rows, np.array(labels, int))
    yield pa.RecordBatch.from_arrays([pa.array([intercept]), pa.array([table.astype("<f4").tobytes()], pa.binary())], ["intercept", "machine"])


def train(docs: DataFrame, labels: DataFrame, label: str, usable, sample_rows: int = SAMPLE_ROWS) -> tuple[float, np.ndarray]:
    """Fit on at most ``sample_rows`` texts of either class; the model has a fixed size of 2.4 MB.

    As both classes weigh the same in the fit, the intercept is moved to the share of class 1 among all usable labels.
    """
    sample, share = labelled_sample(docs, labels, label, usable, sample_rows)
    features = sample.mapInArrow(_features, "columns array<int>, values array<double>, label int")
    # Sorted, so that a rerun draws the same batches.
    features = features.repartition(1).sortWithinPartitions("label", F.xxhash64("columns"), F.xxhash64("values"))
    row = features.mapInArrow(_fit, "intercept double, machine binary").first()
    if row is None:
        return 20.0, np.zeros((FEATURES, RANK + 1), np.float32)
    intercept = row["intercept"]
    if 0 < share < 1:
        intercept += float(np.log(share / (1 - share)))
    return intercept, np.frombuffer(row["machine"], "<f4").reshape(FEATURES, RANK + 1)


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Score every whole text: the columns ``keep`` (default: all) and the score, from 0 to 1, as ``name``.

    Words and structure come from the text alone. NULL counts as empty, and an empty text is scored by its structure.
    Labels may cover ids that are missing or repeated; labels other than 0 and 1 are ignored. Without labels of both
    classes every score is near 1 (or near 0 if all are 0).
    """
    usable = F.coalesce(fold("doc_id", 4), F.lit(0)) != 2
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "quality", usable))

    def scores(texts: pa.Array) -> list[pa.Array]:
        intercept, table = model.value
        margins = []
        for columns, values in features_of(texts):
            own = table[columns].astype(np.float64)
            margins.append(intercept + float(own[:, 0] @ values) + interactions(own[:, 1:], values))
        return [pa.array(1 / (1 + np.exp(-np.clip(np.array(margins), -30, 30))))]

    return map_texts(docs, scores, [T.StructField(name, T.DoubleType())], keep)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    scored = quality(docs, labels, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
