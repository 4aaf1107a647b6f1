"""Exact similarity join of documents on word shingles, as a T-occurrence search.

A document of n shingles links to another at a Jaccard similarity of p per cent only if both
hold at least T = ceil(n * p / 100) of its shingles. Its inverted lists are divided as in
DivideSkip: the n - T + 1 shortest must hold any partner at least once and are merged; the
T - 1 longest are only probed, by binary search, for the partners found by merging.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.components import components
from siftlake.llm.words import mix, pieces, runs_of, signed, split_words
from siftlake.llm.scratch import Scratch

# Long lists known by name to every task: 16 bytes each, 4 MB in all. Which lists are named only
# orders the work; results do not depend on it.
LONG_LISTS = 1 << 18
# A list is called long from this many documents on.
LONG_LIST = 8
# A long list is merged in this many parts.
PARTS = 64
# Longs of 64 bits in the parity of a set.
PARITY_LONGS = 16


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle as a whole."""
    found = split_words(texts, lower=True)
    hashes = found.hashes()
    runs = runs_of(hashes, words)
    sets = []
    for start, end in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if end - start >= words:
            sets.append(np.unique(runs[start : end - words + 1]))
        elif end > start:
            sets.append(runs_of(hashes[start:end], end - start) ^ np.uint64(end - start))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_class(shingles: np.ndarray) -> int:
    """A hash of a set: documents with equal sets are one class."""
    return int(signed(mix(np.array([np.add.reduce(mix(shingles)) + np.uint64(len(shingles))], np.uint64)))[0])


def _survey(words: int):
    """Per document its class and size (kind 0); shingles that recur within a piece, with counts (kind 1)."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sets = shingle_sets(piece.column("text"), words)
            count = len(sets)
            known = {}
            classes = np.array([set_class(s) for s in sets], np.int64)
            for at, name in enumerate(classes.tolist()):
                known.setdefault(name, at)
            pool = [sets[at] for at in known.values()]
            values, times = np.unique(np.concatenate(pool), return_counts=True)
            values, times = values[times > 1], times[times > 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [count, len(values)]).astype(np.int32)),
                    pa.concat_arrays([piece.column("doc_id"), pa.nulls(len(values), pa.int64())]),
                    pa.array(np.concatenate([classes, signed(values)])),
                    pa.array(np.concatenate([[len(s) for s in sets], times]).astype(np.int64)),
                ],
                ["kind", "doc_id", "hash", "n"],
            )

    return survey


def _short_lists(words: int, percent: int, long_lists):
    """Entries of each class's shortest lists, numbered in the common order: (shingle, part, class, n, at)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, lengths = long_lists.value
        filtered = np.zeros(1 << 22, bool)
        filtered[(named & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        for piece in pieces(batches):
            columns = [[], [], [], [], []]
            if len(seen) > 1_000_000:
                seen.clear()
            for shingles in shingle_sets(piece.column("text"), words):
                size = len(shingles)
                name = set_class(shingles) if size else 0
                if not size or name in seen:
                    continue
                seen.add(name)
                keep = size - -(-size * percent // 100) + 1
                maybe = np.flatnonzero(filtered[(shingles & np.uint64((1 << 22) - 1)).astype(np.int64)])
                place = np.searchsorted(named, shingles[maybe])
                place[place == len(named)] = 0
                hit = named[place] == shingles[maybe] if len(named) else np.zeros(0, bool)
                long, place = maybe[hit], place[hit]
                short = np.delete(shingles, long)[:keep]
                # Long lists come last in the common order, by length, so few documents need them.
                order = np.lexsort((shingles[long], lengths[place]))[: keep - len(short)]
                rest = shingles[long[order]]
                parts = np.zeros(len(short) + len(rest), np.int32)
                parts[len(short) :] = 1 + name % PARTS
                columns[0].append(np.concatenate([short, rest]))
                columns[1].append(parts)
                columns[2].append(np.full(len(parts), name, np.int64))
                columns[3].append(np.full(len(parts), size, np.int32))
                columns[4].append(np.arange(1, len(parts) + 1, dtype=np.int32))
            if columns[0]:
                arrays = [np.concatenate(column) for column in columns]
                arrays[0] = signed(arrays[0])
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["shingle", "part", "class", "n", "at"])

    return entries


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bit string in which each shingle flips one bit.

    What two sets have in common cancels out, so their strings differ in at most as many bits as the sets
    differ in shingles.
    """
    bits = 64 * PARITY_LONGS
    counts = np.bincount((mix(shingles) >> np.uint64(20)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _of_class(words: int):
    """Only texts of the class they were fetched for, once each: a repeated id may bring another one, and the same again."""

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in pieces(batches):
            kept, strings = [], []
            for at, (shingles, name) in enumerate(zip(shingle_sets(piece.column("text"), words), piece.column("class").to_pylist())):
                if name not in seen and set_class(shingles) == name:
                    seen.add(name)
                    kept.append(at)
                    strings.append(parity(shingles))
            if len(seen) > 1_000_000:
                seen.clear()
            found = pa.array([row.tolist() for row in strings], pa.list_(pa.int64()))
            kept_rows = piece.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept_rows.column(n) for n in ("class", "n", "text")), found], ["class", "n", "text", "parity"])

    return of_class


def _probe(words: int, percent: int):
    """Keep the pairs whose overlap, found by binary search of one set in the other, suffices."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text_a"):
            one = shingle_sets(piece.column("text_a"), words)
            two = shingle_sets(piece.column("text_b"), words)
            kept = np.zeros(piece.num_rows, bool)
            for at, (few, many) in enumerate(zip(one, two)):
                if len(few) > len(many):
                    few, many = many, few
                place = np.searchsorted(many, few)
                place[place == len(many)] = 0
                common = int(np.count_nonzero(many[place] == few))
                kept[at] = 100 * common >= percent * (len(one[at]) + len(two[at]) - common)
            yield piece.select(["a", "b"]).filter(pa.array(kept))

    return probe


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    one = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_probe(words, percent), "a long, b long")


def _needed(one: str, other: str, percent: int) -> str:
    """SQL for T: how many shingles linked sets of n and m share at least, ceil((n + m) * p / (100 + p))."""
    both = 100 + percent
    return f"(({percent} * ({one}n + {other}n) + {both - 1}) div {both})"


def _can_link(one: str, other: str, percent: int) -> str:
    """SQL for whether two entries of a list can be the first shingle that two linked sets have in common.

    The first of the T common shingles, in the common order, has T - 1 more after it in either set.
    """
    needed = _needed(one, other, percent)
    return f"({one}at <= {one}n - {needed} + 1 and {other}at <= {other}n - {needed} + 1)"


def _parities_allow(one: str, other: str, percent: int) -> str:
    """SQL for whether two sets may differ in no more shingles than linked sets of their sizes do."""
    bits = f"aggregate(zip_with({one}parity, {other}parity, (x, y) -> bit_count(x ^ y)), 0, (sum, bits) -> sum + bits)"
    return f"({bits} <= {one}n + {other}n - 2 * {_needed(one, other, percent)})"


def _reaching(pairs: DataFrame, shared: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that meet in enough of the merged lists to reach T by the lists left to probe.

    A set's merged lists are the first n - ceil(n * p / 100) + 1 in the common order. Of two sets, all that the one
    whose merged lists end first has in common with the other lies in lists merged for both, or in its
    ceil(n * p / 100) - 1 others; so T minus these is how often the pair has to occur.
    """
    sides = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    merged = shared.join(sides, "class", "left_semi").groupBy("class").agg(F.collect_set("shingle").alias("lists"))
    profiles = texts.select("class", "n", "parity").join(merged, "class")
    one, other = (profiles.select(F.col("class").alias(name), F.struct("n", "parity", "lists").alias(f"of_{name}")) for name in "ab")
    others = f"((greatest(of_a.n, of_b.n) * {percent} + 99) div 100 - 1)"
    occurs = f"size(array_intersect(of_a.lists, of_b.lists)) >= {_needed('of_a.', 'of_b.', percent)} - {others}"
    found = pairs.join(one, "a").join(other, "b")
    return found.where(f"{_parities_allow('of_a.', 'of_b.', percent)} and {occurs}").select("a", "b")


def _mixed_lists(shared: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Entries of the lists whose members are not all connected yet.

    Every entry has the ``component`` of its class and the largest component of its list, ``top``. Entries too
    late in their set to be the first common one with any member of the list are left out.
    """
    joined = components(near, "a", "b").select(F.col("node").alias("class"), "component")
    placed = shared.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    parts = placed.groupBy("shingle", "component").agg(F.count("*").alias("part"), F.min("n").alias("least"), F.max("n").alias("most"))
    lists = parts.groupBy("shingle").agg(
        F.max(F.struct("part", "component")).alias("top"),
        *(F.expr(e) for e in ("min(least) as least", "max(most) as most", "sum(part) as entries", "count(*) as kinds")),
    )
    # Two sets whose sizes differ too much for a link need no comparison.
    mixed = lists.where(f"kinds > 1 and (entries > 2 or 100 * least >= {percent} * most)").select("shingle", F.col("top.component").alias("top"), F.struct(F.col("least").alias("n")).alias("smallest"))
    placed = placed.join(mixed, "shingle").where(f"at <= n - {_needed('', 'smallest.', percent)} + 1")
    return placed.drop("smallest")


def jaccard_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``, the smallest linked id.

    Words are runs of bytes other than white space, with A-Z lower-cased; two documents link
    if 100 * intersection >= percent * union of their distinct shingles of ``words`` words. The
    result is exact up to collisions of 64-bit hashes.

    * Documents with equal sets are one class. Only classes are compared, so copies cost nothing.
    * A class's shortest lists are merged by shingle; pairs are dropped that meet too late to
      reach T. Lists that recur often are named first (a bounded list, counted over all
      documents) and rank last in the common order.
    * Each list links its members to one of them, if probing confirms it. Members of
      a list that are still in different components are then compared. Any two linked classes
      share a list, so either they are already connected or they are compared.
    * A pair is only made if the parities of both sets, 1,024 bits in which common shingles cancel out, leave room for it,
      and only probed if it occurs in enough merged lists to reach T with those left over.

    NULL or empty texts have no shingles and link with nothing, nor do NULL ids, whose
    component is NULL. Repeated rows and ids are kept as they are. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    survey = scratch.write(
        base.mapInArrow(_survey(words), "kind int, doc_id long, hash long, n long"), "jaccard-survey"
    )
    members = survey.where("kind = 0").select("doc_id", F.col("hash").alias("class"), "n")
    counted = survey.where("kind = 1").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= LONG_LIST)
    named = counted.orderBy(F.desc("n"), "hash").limit(LONG_LISTS).toPandas()
    hashes = named["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    long_lists = spark.sparkContext.broadcast((hashes[order], named["n"].to_numpy(np.int64)[order]))

    usable = base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text")
    entries = usable.mapInArrow(_short_lists(words, percent, long_lists), "shingle long, part int, class long, n int, at int")
    lists = Window.partitionBy("shingle", "part")
    shared = entries.withColumns({"least": F.min("class").over(lists), "most": F.max("class").over(lists)})
    shared = shared.where((F.col("least") < F.col("most")) | (F.col("part") != 0))
    shared = scratch.write(shared.select("shingle", "class", "n", "at").distinct(), "jaccard-lists")

    wanted = shared.select("class").distinct()
    chosen = members.join(wanted, "class", "left_semi").where("doc_id is not null")
    chosen = chosen.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("n").cast("int").alias("n"))
    # Rows of one id meet in one task, where those with equal texts are merged.
    texts = base.where("text is not null").join(chosen.hint("merge"), "doc_id").select("class", "n", "text")
    texts = scratch.write(texts.mapInArrow(_of_class(words), "class long, n int, text string, parity array<long>"), "jaccard-texts")

    # The member that has the shingle earliest has the fewest rare ones, so it is close to most others.
    hubs = shared.groupBy("shingle").agg(F.min(F.struct("at", "class", "n")).alias("hub"))
    star = shared.join(hubs, "shingle").where("class <> hub.class").where(_can_link("", "hub.", percent))
    star = star.select(F.col("hub.class").alias("a"), F.col("class").alias("b")).distinct()
    star = scratch.write(star, "jaccard-star")
    near = _verified(_reaching(star, shared, texts, percent), texts, words, percent)
    near = scratch.write(near, "jaccard-near")

    placed = _mixed_lists(shared, near, percent).join(texts.select("class", "parity"), "class")
    placed = scratch.write(placed, "jaccard-mixed")
    outside = placed.where("component <> top")
    outside = outside.select("shingle", F.struct("class", "n", "at", "component", "parity").alias("other"))
    # Of two members that are both outside, one order is enough.
    apart = "component <> other.component and (component = top or class < other.class)"
    possible = f"{_can_link('', 'other.', percent)} and {_parities_allow('', 'other.', percent)}"
    cross = outside.join(placed, "shingle").where(f"{apart} and {possible}")
    cross = cross.select(F.least("class", "other.class").alias("a"), F.greatest("class", "other.class").alias("b")).distinct()
    cross = scratch.write(cross.join(star, ["a", "b"], "left_anti"), "jaccard-cross")
    near = near.unionByName(_verified(_reaching(cross, shared, texts, percent), texts, words, percent))

    linked = components(near, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("root"))
    scratch.discard(*(table for table, _ in scratch.folders if table is not survey))
    named_classes = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    named_classes = named_classes.join(linked, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named_classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed_classes = named_classes.join(least, "root").select("class", "component_id")
    full = members.join(placed_classes, "class", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id"))
    return full.select(
        F.col("doc_id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.otherwise(F.col("component_id")).alias("component_id"),
    )
