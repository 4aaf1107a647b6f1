"""Words and their hashes, taken from whole Arrow batches of texts at once.

A word is a run of bytes other than space and the controls 0x09-0x0D, so words can be found
in UTF-8 without decoding it. Hashes are 64 bits wide and depend on nothing but the words, so
every task computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes handled at once inside a task; only a single longer text exceeds it.
PIECE_BYTES = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_SHIFT = np.uint64(32)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    values = (values ^ (values >> _SHIFT)) * _B
    values = (values ^ (values >> _SHIFT)) * _B
    return values ^ (values >> _SHIFT)


@dataclass(frozen=True)
class Words:
    """Words of several texts: byte places in ``data`` and, per text, the first word's number."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, read eight bytes at a time."""
        lengths = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        values = lengths.astype(np.uint64) * _A
        step, left = 0, np.arange(len(lengths))
        while len(left):
            rest = lengths[left] - step
            part = eights[self.starts[left] + step] & _MASKS[np.minimum(rest, 8)]
            mixed = (values[left] ^ part) * _B
            values[left] = (mixed ^ (mixed >> _SHIFT)) * _C
            left, step = left[rest > 8], step + 8
        return mix(values)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them; NULL counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found[places[0] : places[-1]], places - places[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + upper.astype(np.uint8) * np.uint8(32)


def split_words(texts: pa.Array, lower: bool = False, inside: np.ndarray | None = None) -> Words:
    """Words of bytes other than white space, or of those that ``inside``, a mask of 256 entries, names."""
    data, offsets = text_bytes(texts)
    return _split(lower_ascii(data) if lower else data, offsets, ~_SPACE if inside is None else inside)


def _split(data: np.ndarray, offsets: np.ndarray, of_words: np.ndarray) -> Words:
    inside = of_words[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive values, in order of its start."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(length):
            total += hashes[at : at + count] * factor
            factor = factor * _A
    return mix(total)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece take a bounded number of bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def packed(names: list[str]) -> Column:
    """The named columns as one struct, which is never empty: a marker with a name of its own comes first."""
    marker = "__row"
    while marker.lower() in {name.lower() for name in names}:
        marker += "_"
    return F.struct(F.lit(True).alias(marker), *(F.col(f"`{name}`") for name in names))


def map_texts(docs: DataFrame, results, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and those that ``results`` makes of each text.

    ``results`` turns an array of texts into one array per field, in a narrow step over bounded
    pieces. The kept columns travel as one struct, so their names and types do not matter; one that has
    the name of a result is replaced by it.
    """
    names = [field.name for field in fields]
    keep = [name for name in (docs.columns if keep is None else keep) if name not in names]
    rest = packed([name for name in keep if name != "text"])
    table = docs.select(rest.alias("row"), F.col("text").cast("string").alias("text"))
    with_text = "text" in keep

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            columns = [piece.column("row"), *([piece.column("text")] if with_text else []), *results(piece.column("text"))]
            yield pa.RecordBatch.from_arrays(columns, ["row", *(["text"] if with_text else []), *names])

    schema = T.StructType([table.schema["row"], *([table.schema["text"]] if with_text else []), *fields])
    mapped = table.mapInArrow(step, schema)
    return mapped.select(*(F.col("text") if n == "text" else F.col(f"row.`{n}`") for n in keep), *names)
