"""Occurrences of test phrases in documents, by an FM-index over each shard of the documents.

Only words of the test items have numbers; a run of such words is the only place where a phrase
can stand, so all else becomes the end of a run and short runs are left out. The runs of a
shard are sorted by their suffixes; the words before each, in that order, form a wavelet matrix,
whose ranks answer a backward search for all phrases at once, one word a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.words import packed, pieces, split_words

# Every so many positions of a shard one suffix keeps its place; others step to it.
SAMPLE_STEP = 8
# Bytes of test items searched for in one pass; more items take more passes, all in one stage.
ITEM_BYTES = 4 << 20
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class WaveletMatrix:
    """Rank of any symbol up to any place, by one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros(len(places), np.int64)
        high = places.astype(np.int64)
        for ones, zeros, level in zip(self.ones, self.zeros, reversed(range(self.bits))):
            bit = ((symbols >> level) & 1).astype(bool)
            below, above = ones[low], ones[high]
            low = np.where(bit, zeros + below, low - below)
            high = np.where(bit, zeros + above, high - above)
        return high - low

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbols = np.zeros(len(places), np.int64)
        low, place = np.zeros(len(places), np.int64), places.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = (ones[place + 1] - ones[place]).astype(bool)
            symbols = symbols * 2 + bit
            low = np.where(bit, zeros + ones[low], low - ones[low])
            place = np.where(bit, zeros + ones[place], place - ones[place])
        return symbols, place - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling. Each 0 ends a run and ranks by its place, so nothing is compared beyond it."""
    size = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width = 1
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order)
    # Only suffixes that are not yet alone in their rank are compared further.
    while len(tied := np.flatnonzero(np.bincount(rank)[rank] > 1) if size else rank):
        after = np.full(len(tied), -1, np.int64)
        inside = tied + width < size
        after[inside] = rank[tied[inside] + width]
        sub = np.lexsort((after, rank[tied]))
        tied, after = tied[sub], after[sub]
        groups = rank[tied]
        fresh = np.concatenate([[True], groups[1:] != groups[:-1]])
        split = fresh | np.concatenate([[True], after[1:] != after[:-1]])
        # A suffix's rank is the place where those equal to it so far begin.
        within = np.arange(len(tied)) - np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))
        begin = np.maximum.accumulate(np.where(split, np.arange(len(tied)), 0))
        rank = rank.copy()
        rank[tied] = groups + within[begin]
        width *= 2
    order = np.empty(size, np.int64)
    order[rank] = np.arange(size)
    return order


def _ranks(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each element's rank: the place where its equals begin."""
    rank = np.empty(len(order), np.int64)
    begin = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(order) else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
    return rank


class FMIndex:
    """An index over runs of symbols from 1 on, each run ended by a 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        # Every run is preceded by a 0, the first one by the last.
        self.tree = WaveletMatrix(symbols[order - 1], max(1, int(alphabet).bit_length()))
        starts = np.concatenate([[True], symbols[:-1] == 0]) if self.size else np.zeros(0, bool)
        kept = (order % SAMPLE_STEP == 0) | starts[order]
        self.sampled = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; ``phrases`` has one row each, filled up with 0."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for step in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                continue
            symbols = phrases[live, lengths[live] - step]
            begin = self.before[symbols]
            low[live] = begin + self.tree.rank(symbols, low[live])
            high[live] = begin + self.tree.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of the suffix in each row of the order."""
        rows = rows.astype(np.int64)
        found, steps = np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            hit = self.sampled[at + 1] > self.sampled[at]
            found[left[hit]] = self.places[self.sampled[at[hit]]] + steps
            left = left[~hit]
            symbols, rank = self.tree.at(rows[left])
            rows[left] = self.before[symbols] + rank
            steps += 1
        return found


@dataclass(frozen=True)
class Phrases:
    """Distinct windows of test items as numbers of words, and the items that hold each window."""

    words: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    names: np.ndarray
    first: np.ndarray
    owners: np.ndarray

    @staticmethod
    def of(ids: list, texts: pa.Array, size: int) -> Phrases:
        """Items without an id have windows but are not among the items of any."""
        found = split_words(texts, lower=True, inside=ALPHANUMERIC)
        words, numbers = np.unique(found.hashes(), return_inverse=True)
        padded = np.concatenate([numbers.astype(np.int32) + 1, np.zeros(size, np.int32)])
        counts = found.counts()
        length = np.minimum(counts, size)
        times = np.where(counts > 0, counts - length + 1, 0)
        owner = np.repeat(np.arange(len(counts)), times)
        start = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + found.first[:-1][owner]
        table = padded[start[:, None] + np.arange(size)]
        table[np.arange(size) >= length[owner][:, None]] = 0
        windows, window = np.unique(table, axis=0, return_inverse=True)
        names, name = np.unique(np.array(["" if i is None else i for i in ids], object).astype(str), return_inverse=True)
        named = np.array([i is not None for i in ids], bool)[owner]
        pairs = np.unique(np.stack([window.ravel()[named], name[owner][named]]), axis=1)
        first = np.searchsorted(pairs[0], np.arange(len(windows) + 1))
        return Phrases(words, windows, np.count_nonzero(windows, axis=1), names, first, pairs[1])

    def items_of(self, windows: np.ndarray) -> list[str]:
        windows = np.unique(windows)
        owners = [self.owners[self.first[w] : self.first[w + 1]] for w in windows.tolist()]
        return self.names[np.unique(np.concatenate(owners))].tolist()


def occurrences(hashes: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word, window) of every occurrence in the texts of a shard, whose words are ``hashes``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.windows) or not len(hashes):
        return none
    slots = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[(phrases.words & slots).astype(np.int64)] = True
    candidates = np.flatnonzero(maybe[(hashes & slots).astype(np.int64)])
    place = np.minimum(np.searchsorted(phrases.words, hashes[candidates]), len(phrases.words) - 1)
    hit = phrases.words[place] == hashes[candidates]
    words, numbers = candidates[hit], place[hit] + 1
    if not len(words):
        return none
    # A run goes on while the next word is the next known one, of the same text.
    text = np.searchsorted(first, words, side="right")
    fresh = np.concatenate([[True], (np.diff(words) != 1) | (np.diff(text) != 0)])
    run = np.cumsum(fresh) - 1
    length = np.bincount(run)
    long = length[run] >= phrases.lengths.min()
    words, numbers, run = words[long], numbers[long], run[long]
    if not len(words):
        return none
    _, run = np.unique(run, return_inverse=True)
    symbols = np.zeros(len(words) + run[-1] + 1, np.int64)
    origin = np.zeros(len(symbols), np.int64)
    symbols[np.arange(len(words)) + run] = numbers
    origin[np.arange(len(words)) + run] = words
    index = FMIndex(symbols, len(phrases.words))
    low, high = index.search(phrases.windows, phrases.lengths)
    times = high - low
    window = np.repeat(np.arange(len(times)), times)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    return origin[index.locate(rows)], window


_FIELDS = "__n_words long, __spans array<struct<start:long,stop:long>>, __items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch become one; by start."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[fresh], ends[np.concatenate([fresh[1:], [True]])]


def _search(phrases):
    """Add to each text the spans and items found by this block of phrases; nothing leaves its task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Phrases = phrases.value
        for piece in pieces(batches):
            found = split_words(piece.column("text"), lower=True, inside=ALPHANUMERIC)
            words, windows = occurrences(found.hashes(), found.first, block)
            text = np.searchsorted(found.first, words, side="right") - 1
            order = np.argsort(text, kind="stable")
            words, windows, text = words[order], windows[order], text[order]
            cuts = np.searchsorted(text, np.arange(piece.num_rows + 1))
            spans, items = piece.column("__spans").to_pylist(), piece.column("__items").to_pylist()
            for at in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[at], cuts[at + 1])
                start = np.concatenate([words[own] - found.first[at], np.array([s["start"] for s in spans[at]], np.int64)])
                end = np.concatenate([words[own] - found.first[at] + block.lengths[windows[own]], np.array([s["stop"] for s in spans[at]], np.int64)])
                spans[at] = [{"start": a, "stop": b} for a, b in zip(*(x.tolist() for x in _merged(start, end)))]
                items[at] = sorted({*items[at], *block.items_of(windows[own])})
            columns = [piece.column("row"), piece.column("text"), pa.array(found.counts(), pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "__n_words", "__spans", "__items"])

    return search


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, size: int = 10) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all), ``n_words``, ``spans`` and ``items``, a row for every row.

    ``spans`` are the merged (start, stop) word ranges that hold windows of ``size`` consecutive words of
    items (item_id, text), or whole shorter items; ``items`` the ids found, as sorted strings. Words are runs of digits, letters
    a-z and bytes beyond ASCII, with A-Z lower-cased.

    Documents stay where they are: each task indexes its texts in shards of bounded bytes. Items are taken in
    blocks of bounded bytes, dealt by a hash; only a single longer item exceeds them. All blocks are searched in one stage.

    NULL and empty texts have no words and no spans, items without words match nothing, items without an id
    give spans only, and equal item ids count once. Empty tables and repeated rows are no special case; a column that is called
    as a result is replaced by it.
    """
    spark = docs.sparkSession
    names = ["n_words", "spans", "items"]
    keep = [name for name in (docs.columns if keep is None else keep) if name not in names]
    table = docs.select(
        packed(keep).alias("row"),
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("__n_words"),
        F.array().cast("array<struct<start:long,stop:long>>").alias("__spans"),
        F.array().cast("array<string>").alias("__items"),
    )
    kind = table.schema["row"].dataType.simpleString()
    known = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = known.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    blocks = -(-total // ITEM_BYTES) or 1
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        found = Phrases.of(own.column("item_id").to_pylist(), pa.array(own.column("text").to_pylist(), pa.string()), size)
        table = table.mapInArrow(_search(spark.sparkContext.broadcast(found)), f"row {kind}, text string, {_FIELDS}")
    results = [F.col(f"__{name}").alias(name) for name in names]
    return table.select(*(F.col(f"row.`{name}`") for name in keep), *results)


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document how many words are hit by how many items, and the digest of their ids."""
    found = contamination(docs, items, ["doc_id"])
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_spans(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents with contaminated word spans cut out of their texts; other texts stay as they are.

    What stands before a span's first word and after its last one is joined by one space.
    """
    rest = [name for name in docs.columns if name != "text"]
    table = docs.select(packed(rest).alias("row"), F.col("text").cast("string").alias("text"))
    found = contamination(table, items, size=size).select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = split_words(piece.column("text"), lower=True, inside=ALPHANUMERIC)
            texts = piece.column("text").to_pylist()
            before = 0
            for at, spans in enumerate(piece.column("spans").to_pylist()):
                data = (texts[at] or "").encode()
                if spans:
                    first, parts, place = words.first[at], [], 0
                    for span in spans:
                        parts.append(data[place : words.starts[first + span["start"]] - before].rstrip())
                        place = words.ends[first + span["stop"] - 1] - before
                    texts[at] = b" ".join(p for p in [*parts, data[place:].lstrip()] if p).decode()
                before += len(data)
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    result = found.mapInArrow(cut, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return result.select(*(F.col("text") if name == "text" else F.col(f"row.`{name}`") for name in docs.columns))
