"""Ranked lexical search of all items over all documents, by descending two trees at once.

Documents of a batch and items are both arranged in trees whose nodes hold the largest value of
each coordinate below them. The product of two nodes bounds the score of every pair below; where it
is under the weakest k-th score of the node's items, the whole block of pairs is left out. All
numbers are integers, so bounds and scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.phrases import ALPHANUMERIC
from siftlake.llm.scratch import Scratch
from siftlake.llm.words import pieces, split_words

# Children per node of either tree; a batch's documents are three levels deep.
FAN_OUT = 8
# Bytes of items searched for in one pass, and of the coordinates of one batch of documents.
ITEM_BYTES = 256 << 10
BATCH_BYTES = 16 << 20
# The largest value of a coordinate is below 10**9 / 10**3; doubles hold integers up to 2**53.
SCALE, LARGEST, EXACT = 1_000_000_000, 1_000_000, 1 << 53

_COUNTS = "kind int, doc_id long, n long, terms array<int>, times array<int>"


@dataclass(frozen=True)
class Items:
    """A block of distinct item texts: the sorted hashes of their terms, and each item's terms as numbers."""

    keys: list[str]
    vocabulary: np.ndarray
    terms: list[np.ndarray]

    @staticmethod
    def of(keys: list[str], texts: list[str]) -> Items:
        found = split_words(pa.array(texts, pa.string()), lower=True, inside=ALPHANUMERIC)
        vocabulary, numbers = np.unique(found.hashes(), return_inverse=True)
        return Items(keys, vocabulary, [np.unique(numbers[a:b]) for a, b in zip(found.first[:-1], found.first[1:])])


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _count(items):
    """Per document its length and the counts of known terms (kind 0).

    Per piece of documents (kind 1): those with terms as ``doc_id``, their terms as ``n``, and how many hold each known term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = items.value.vocabulary
        width = max(1, len(vocabulary))
        slots = np.uint64((1 << 20) - 1)
        maybe = np.zeros(1 << 20, bool)
        maybe[(vocabulary & slots).astype(np.int64)] = True
        for piece in pieces(batches):
            found = split_words(piece.column("text"), lower=True, inside=ALPHANUMERIC)
            hashes, sizes = found.hashes(), found.counts()
            known = np.flatnonzero(maybe[(hashes & slots).astype(np.int64)])
            place = np.minimum(np.searchsorted(vocabulary, hashes[known]), width - 1)
            hit = vocabulary[place] == hashes[known] if len(vocabulary) else np.zeros(0, bool)
            cells, times = np.unique(found.text_of_word()[known[hit]] * width + place[hit], return_counts=True)
            cuts = np.searchsorted(cells, np.arange(piece.num_rows + 1) * width)
            held, holders = np.unique(cells % width, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [piece.num_rows, 1]).astype(np.int32)),
                    pa.concat_arrays([piece.column("doc_id"), pa.array([int((sizes > 0).sum())], pa.int64())]),
                    pa.array(np.concatenate([sizes, [sizes.sum()]]).astype(np.int64)),
                    _lists(np.concatenate([cells % width, held]), np.concatenate([cuts, [len(cells) + len(held)]])),
                    _lists(np.concatenate([times, holders]), np.concatenate([cuts, [len(cells) + len(held)]])),
                ],
                ["kind", "doc_id", "n", "terms", "times"],
            )

    return count


@dataclass(frozen=True)
class Statistics:
    """What scores need of the whole collection: documents and terms in all, and the weight of each known term."""

    documents: int
    terms: int
    weights: np.ndarray

    @staticmethod
    def of(documents: int, terms: int, holders: dict[int, int], size: int) -> Statistics:
        found = [math.floor(1000 * math.log((2 * documents + 2) / (2 * holders.get(at, 0) + 1))) for at in range(size)]
        return Statistics(documents, terms, np.array(found, np.int64))

    def length_part(self, sizes: list[int]) -> np.ndarray:
        """``m`` of documents of so many terms; Python's integers, as products may leave 64 bits."""
        return np.array([10 + 90 * n * self.documents // max(1, self.terms) for n in sizes], np.int64)


def tree_levels(leaves: np.ndarray, depth: int) -> list[np.ndarray]:
    """Rows of coordinate maxima, from the roots down to the leaves themselves."""
    levels = [leaves]
    for _ in range(depth):
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN_OUT), axis=0))
    return levels[::-1]


def _least_below(values: np.ndarray, depth: int) -> list[np.ndarray]:
    levels = [values]
    for _ in range(depth):
        levels.append(np.minimum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN_OUT)))
    return levels[::-1]


def _children(active: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return active.repeat(FAN_OUT, 0)[:rows].repeat(FAN_OUT, 1)[:, :columns]


def surviving_pairs(docs: list[np.ndarray], items: list[np.ndarray], bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, score) of all pairs whose score reaches the item's bar.

    Both trees are descended level by level; ``bars`` are lowered to the weakest below each item node.
    """
    active = np.ones((len(docs[0]), len(items[0])), bool)
    for doc_level, item_level, bar in zip(docs, items, _least_below(bars, len(items) - 1)):
        if active.shape != (len(doc_level), len(item_level)):
            active = _children(active, len(doc_level), len(item_level))
        rows, columns = np.flatnonzero(active.any(1)), np.flatnonzero(active.any(0))
        scores = doc_level[rows] @ item_level[columns].T
        inside = active[np.ix_(rows, columns)] & (scores >= bar[columns])
        active = np.zeros_like(active)
        active[np.ix_(rows, columns)] = inside
    row, column = np.nonzero(inside)
    return rows[row], columns[column], scores[row, column]


class Best:
    """The best ``k`` documents of every item so far; equal scores go to smaller ids, NULL ids come last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.found = [np.zeros(0, np.int64) for _ in range(4)]
        # Scores must be above 0.
        self.bars = np.ones(items, np.int64)

    def add(self, items: np.ndarray, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        both = [np.concatenate([a, b.astype(np.int64)]) for a, b in zip(self.found, (items, scores, missing, ids))]
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        both = [column[order] for column in both]
        begin = np.searchsorted(both[0], both[0])
        rank = np.arange(len(begin)) - begin
        self.found = [column[rank < self.k] for column in both]
        last = rank[rank < self.k] == self.k - 1
        self.bars[self.found[0][last]] = self.found[1][last]


def _search(items, statistics, k: int):
    """The best documents of each item among those of one task: (item_key, doc_id, score)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = items.value, statistics.value
        width, count = len(block.vocabulary), len(block.keys)
        heaviest = max((int(known.weights[terms].sum()) for terms in block.terms), default=0)
        kind = np.float64 if heaviest * LARGEST < EXACT else np.int64
        # Items that begin with the same common terms lie together, so their maxima stay low.
        common = np.argsort(np.argsort(known.weights, kind="stable"))
        order = sorted(range(count), key=lambda at: sorted(common[block.terms[at]].tolist()))
        weights = np.zeros((count, width), kind)
        for row, at in enumerate(order):
            weights[row, block.terms[at]] = known.weights[block.terms[at]]
        item_tree = tree_levels(weights, 2)
        best = Best(count, k)
        step = max(1, BATCH_BYTES // (8 * max(1, width)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                if not sizes.sum():
                    continue
                owner = np.repeat(np.arange(part.num_rows), sizes)
                terms, times = (part.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in ("terms", "times"))
                length = known.length_part(part.column("n").to_pylist())[owner]
                values = np.zeros((part.num_rows, width), kind)
                values[owner, terms] = SCALE * times // (1000 * times + 8 * length)
                # Documents whose heaviest known term is the same lie together.
                heaviest_term = (values * known.weights).argmax(1)
                places = np.argsort(heaviest_term, kind="stable")
                row, item, score = surviving_pairs(tree_levels(values[places], 2), item_tree, best.bars)
                ids = part.column("doc_id")
                missing = ids.is_null().to_numpy(zero_copy_only=False)[places]
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)[places]
                best.add(item, score, missing[row], ids[row])
        item, score, missing, ids = best.found
        names = [block.keys[order[at]] for at in item.tolist()]
        columns = [pa.array(names, pa.string()), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item_key", "doc_id", "score"])

    return search


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ``k`` best documents for every row of ``items`` (item_id, text): item_id, ``rank``, doc_id, ``score``.

    Terms are runs of digits, letters a-z and bytes beyond ASCII, with A-Z lower-cased. A term's weight is
    floor(1000 * ln((2N + 2) / (2df + 1))) over the N documents with terms; a document of n terms adds
    10^9 tf div (1000 tf + 8 (10 + 90 n N div L)) of it, L being all terms. Scores of 0 are left out.

    Texts are read once for a block of items of bounded bytes (a single longer item exceeds them); blocks are dealt by
    a hash. Counts of known terms are written, and every task then searches its documents for all items of the block and
    returns at most k rows an item.

    NULL and empty texts have no terms and are no documents; documents with a NULL id rank last among equals. Rows
    that repeat an id are ranked each on its own, and so are repeated items; equal item texts are searched for once.
    Empty tables give no rows, and other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    wanted = items.where("text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    wanted = wanted.select("item_id", F.sha2("text", 256).alias("item_key"), "text")
    texts = wanted.select("item_key", "text").dropDuplicates(["item_key"])
    total = texts.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    blocks = -(-total // ITEM_BYTES) or 1
    found = None
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == block).orderBy("item_key").toArrow()
        known = Items.of(own.column("item_key").to_pylist(), own.column("text").to_pylist())
        shared = spark.sparkContext.broadcast(known)
        counts = scratch.write(base.mapInArrow(_count(shared), _COUNTS), "ranking-counts")
        pieces_seen = counts.where("kind = 1")
        sums = pieces_seen.agg(F.sum("doc_id").alias("documents"), F.sum("n").alias("terms")).first()
        holders = pieces_seen.select(F.explode(F.arrays_zip("terms", "times")).alias("t")).groupBy("t.terms").agg(F.sum("t.times").alias("n"))
        statistics = Statistics.of(sums["documents"] or 0, sums["terms"] or 0, {r["terms"]: r["n"] for r in holders.collect()}, len(known.vocabulary))
        best = counts.where("kind = 0 and size(terms) > 0").select("doc_id", "n", "terms", "times")
        best = best.mapInArrow(_search(shared, spark.sparkContext.broadcast(statistics), k), "item_key string, doc_id long, score long")
        best = scratch.write(best, "ranking-best")
        scratch.discard(counts)
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return wanted.select("item_id", "item_key").join(best, "item_key").select("item_id", "rank", "doc_id", "score")
