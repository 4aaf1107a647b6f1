"""Near duplicates among embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Vectors that have at
least two of them in common meet in the inverted list of such a pair of pivots, and only there are
their cosines computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.components import components
from siftlake.llm.scratch import Scratch

# Nearest pivots that describe a vector. Two vectors are compared if they share SHARED of them.
NEAREST = 6
SHARED = 2
MIN_PIVOTS, MAX_PIVOTS = 128, 4096
# Vectors sampled per pivot, and the cosine from which on two of them are too close to be both pivots.
SAMPLED, APART = 4, 0.7
# Longer lists are cut into parts that are compared pairwise, in tasks of their own.
PART_ROWS = 1024
_PAIRS = np.array(list(combinations(range(NEAREST), SHARED)))


def pivot_count(vectors: int) -> int:
    """Pivots for so many vectors: lists of pairs of pivots stay short while the vectors grow with the square."""
    wanted = 1 << max(0, int(np.ceil(np.log2(max(1.0, np.sqrt(vectors))))) - 1)
    return min(MAX_PIVOTS, max(MIN_PIVOTS, wanted))


def spread_out(vectors: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors of a sample in order, without those close to an earlier one.

    Copies of one vector would make poor pivots: which of them are nearest is chance.
    """
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    kept = np.empty((most, unit.shape[1]))
    count = 0
    for vector in unit:
        if count < most and (not count or (kept[:count] @ vector).max() < APART):
            kept[count] = vector
            count += 1
    return kept[:count]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest pivots, in rising order of number, padded with -1."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :NEAREST]
    found = np.full((len(vectors), NEAREST), -1, np.int32)
    found[:, : order.shape[1]] = order
    return np.sort(found, axis=1)


def _lists(pivots):
    """Entries of every vector in the lists of its pivot pairs."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width = pivots.value
        for batch in batches:
            widths = batch.column("width").to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                near = nearest_pivots(_matrix(part.column("vector"), width), by_width[width])
                rows = np.repeat(np.arange(part.num_rows), len(_PAIRS))
                pairs = near[:, _PAIRS].reshape(-1, SHARED).astype(np.int64)
                real = (pairs >= 0).all(axis=1)
                # Fewer pivots than a pair: one list holds all.
                if len(by_width[width]) < SHARED:
                    real = np.zeros(len(rows), bool)
                    real[:: len(_PAIRS)] = True
                taken = part.take(pa.array(rows[real]))
                tops = pa.FixedSizeListArray.from_arrays(pa.array(near[rows[real]].ravel()), NEAREST).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array((pairs[real, 0] << 32) | (pairs[real, 1] & 0xFFFFFFFF)), tops],
                    [*batch.schema.names, "pair", "tops"],
                )

    return lists


def _same_list(keys: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """All pairs of rows in runs of equal keys, by distance; longer runs are returned as ranges."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(cuts)
    size = np.repeat(sizes, sizes)
    left, right, live, step = [], [], np.flatnonzero(size <= most), 1
    end = np.repeat(cuts[1:], sizes)
    while True:
        live = live[live + step < end[live]]
        if not len(live):
            break
        left.append(live)
        right.append(live + step)
        step += 1
    ranges = [(int(cuts[at]), int(cuts[at + 1])) for at in np.flatnonzero(sizes > most)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), ranges


def _roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row connected to each row."""
    roots = np.arange(count)
    while True:
        least = np.minimum(roots[left], roots[right])
        after = roots.copy()
        np.minimum.at(after, left, least)
        np.minimum.at(after, right, least)
        after = after[after]
        if (after == roots).all():
            return roots
        roots = after


def _compare(cosine: float):
    """Links among the entries of each list: per entry how many vectors it links with, and one connected smaller entry."""

    def compared(table: pa.Table) -> pa.RecordBatch:
        widths = table.column("width").to_numpy()
        parts = [table.filter(pa.array(widths == width)) for width in np.unique(widths)]
        found = [_linked(part, int(part.column("width")[0].as_py()), cosine) for part in parts]
        ids, counts, roots = (np.concatenate(column) for column in zip(*found))
        kept = (counts > 0) | (roots != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(counts[kept]), pa.array(roots[kept])], ["key", "links", "root"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Entries arrive sorted by block; a block may begin in one batch and end in the next.
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 4 * PART_ROWS:
                continue
            table = pa.Table.from_batches(held)
            blocks = table.column("block").to_numpy()
            cut = int(np.searchsorted(blocks, blocks[-1]))
            if cut:
                yield compared(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield compared(pa.Table.from_batches(held))

    return step


def _linked(table: pa.Table, width: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    blocks, ids = table.column("block").to_numpy(), table.column("key").to_numpy()
    side, halves = table.column("part").to_numpy(), table.column("other").to_numpy()
    vectors = _matrix(table.column("vector").chunk(0), width)
    tops = table.column("tops").chunk(0).flatten().to_numpy().reshape(-1, NEAREST)
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / norms[:, None]
    left, right, ranges = _same_list(blocks)
    lefts, rights = [left[:0]], [right[:0]]
    for at in range(0, len(left), 1 << 16):
        one, two = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        near = np.einsum("ij,ij->i", unit[one], unit[two]) >= cosine - 1e-9
        lefts.append(one[near])
        rights.append(two[near])
    for start, end in ranges:
        one, two = np.nonzero(np.triu(unit[start:end] @ unit[start:end].T >= cosine - 1e-9, 1))
        lefts.append(one + start)
        rights.append(two + start)
    left, right = np.concatenate(lefts), np.concatenate(rights)
    # A list cut into parts is compared within each part once, and between parts in blocks of two.
    apart = (side[left] != side[right]) | (side[left] == halves[left])
    exact = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 16):
        one, two = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        exact[at : at + (1 << 16)] = np.einsum("ij,ij->i", vectors[one], vectors[two]) / (norms[one] * norms[two]) >= cosine
    left, right = left[apart & exact], right[apart & exact]
    # A pair that shares several lists counts in that of its two smallest common pivots.
    pair = table.column("pair").to_numpy()
    counted = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 16):
        one, two = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        common = (tops[one][:, :, None] == tops[two][:, None, :]).any(axis=2) & (tops[one] >= 0)
        many = common.sum(axis=1) >= SHARED
        first = common.argmax(axis=1)
        common[np.arange(len(one)), first] = False
        second = common.argmax(axis=1)
        rows = np.arange(len(one))
        owner = (tops[one][rows, first].astype(np.int64) << 32) | (tops[one][rows, second].astype(np.int64) & 0xFFFFFFFF)
        counted[at : at + (1 << 16)] = (owner == pair[one]) | ~many
    one, two = left[counted], right[counted]
    copies = table.column("copies").to_numpy()
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, one, copies[two])
    np.add.at(links, two, copies[one])
    roots = ids[_roots(len(ids), left, right)]
    return ids, links, roots


def near_embeddings(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    cosine: float = 0.93,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors of equal labels link if their cosine, in double precision, is at least ``cosine`` and
    they are found: that is, if they share SHARED of their NEAREST pivots. All vectors are indexed and compared;
    only the pivots come from a bounded sample, by a hash of the ids (SAMPLED * MAX_PIVOTS vectors at
    most for every dimension pass through the driver).

    Equal vectors are one entry with a number of copies, so only different ones are compared. Long lists are cut into
    parts by a hash, and every two parts are compared in a task of their own. A block returns one row
    per linked entry, with its number of links and a connected entry, never the pairs.

    Vectors that are NULL, zero or have NULL or non-finite components link with nothing, nor do
    those without label or id, or of another dimension. Rows that repeat an id link if
    their vectors do, and then count as one node. An empty table gives no rows, and other columns are ignored.
    Entries are told apart by 64-bit hashes of label and vector.
    """
    spark = vectors.sparkSession
    base = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label")
    )
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists("vector", lambda x: x != 0)
    usable = base.where(finite & some & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    usable = usable.withColumn("width", F.size("vector"))
    sizes = {row["width"]: row["n"] for row in usable.groupBy("width").agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for width, count in sizes.items():
        rows = usable.where(F.col("width") == width).orderBy(F.xxhash64("vec_id"), "vec_id")
        rows = rows.limit(SAMPLED * pivot_count(count)).select("vector").collect()
        pivots[width] = spread_out(np.array([row["vector"] for row in rows], float), pivot_count(count))
    pivots = spark.sparkContext.broadcast(pivots)
    named = usable.withColumn("key", F.xxhash64("label", "width", "vector"))
    classes = named.groupBy("key", "label", "width", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    fields = classes.schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", pair long, tops array<int>"
    entries = classes.mapInArrow(_lists(pivots), schema)
    key = ["label", "width", "pair"]
    long_lists = entries.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS)
    entries = entries.join(long_lists, key, "left")
    parts = F.coalesce(F.ceil(F.col("n") / PART_ROWS), F.lit(1)).cast("int")
    entries = entries.withColumn("parts", parts)
    entries = entries.withColumn("part", F.pmod(F.xxhash64("key", "pair"), F.col("parts")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.xxhash64(*key, F.least("part", "other"), F.greatest("part", "other"))
    entries = entries.select("key", "vector", "width", "copies", "pair", "tops", "part", "other", block.alias("block"))
    sorted_entries = entries.repartition("block").sortWithinPartitions("block")
    linked = Scratch(spark).write(sorted_entries.mapInArrow(_compare(cosine), "key long, links long, root long"), "embeddings-linked")

    members = named.groupBy("vec_id", "key").agg(F.count("*").alias("rows"))
    several = members.groupBy("vec_id").agg(F.min("key").alias("root"), F.max("key").alias("most")).where("root < most")
    same_id = members.join(several, "vec_id").where("key <> root").select("key", "root")
    joined = components(linked.where("key <> root").select("key", "root").unionByName(same_id).distinct(), "key", "root")
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "copies", "least").join(counts, "key", "left")
    known = known.join(joined.select(F.col("node").alias("key"), F.col("component").alias("root")), "key", "left")
    known = known.select(
        "key", "least", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    placed = known.join(smallest, "root").select("key", "links", "component")
    found = members.join(placed, "key").groupBy("vec_id").agg(
        F.sum(F.col("rows") * F.col("links")).alias("n_links"), F.min("component").alias("component")
    )
    full = base.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return full.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
