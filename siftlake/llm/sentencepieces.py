"""SentencePiece encoding and decoding with a unigram model: Viterbi over a double-array trie of pieces.

The pieces and their log scores come from a model file. A text's best segmentation is found by
dynamic programming over its bytes, for all distinct segments of a batch at once: every step
moves all of them one byte on in the trie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.words import Words, map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
# What an unknown character costs more than the worst piece.
UNKNOWN_PENALTY = 10.0
# Places of a long segment whose scores are held at once, and below how many rows segments are taken one at a time.
WINDOW, FEW_ROWS = 1 << 16, 64
_WIDTHS = np.ones(256, np.int64)
_WIDTHS[0xC0:0xE0], _WIDTHS[0xE0:0xF0], _WIDTHS[0xF0:] = 2, 3, 4


@dataclass(frozen=True)
class Model:
    """Pieces by id as bytes, with the whitespace marker as a space; the trie over their bytes.

    State s goes to ``base[s] + byte + 1`` where ``check`` of that place is s; ``piece`` gives the id
    of the piece that ends in a state, or -1. ``bytes_from`` is the id of the piece for byte 0,
    or -1 if the model has no byte pieces.
    """

    texts: list[bytes]
    scores: np.ndarray
    unknown: int
    bytes_from: int
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    breaks: np.ndarray
    splits_at_space: bool
    prefix: bool

    @cached_property
    def unknown_score(self) -> float:
        return float(self.scores[self.piece[self.piece >= 0]].min(initial=0.0)) - UNKNOWN_PENALTY

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(text) for text in self.texts])


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack a byte trie into base, check and value arrays, widest nodes first."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys.items():
        state = 0
        for byte in key:
            if byte not in children[state]:
                children[state][byte] = len(children)
                children.append({})
                values.append(-1)
            state = children[state][byte]
        values[state] = value
    size = 4 * len(children) + 4096
    used = np.zeros(size, bool)
    used[: 257 + 1] = True
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    place = {0: 0}
    free, waiting = 258, [0]
    # A child's place needs its parent's, so nodes are packed level by level, the widest first.
    while waiting:
        level = sorted((node for node in waiting if children[node]), key=lambda node: -len(children[node]))
        waiting = []
        for node in level:
            codes = np.array(sorted(children[node])) + 1
            while used[free]:
                free += 1
            spot, window = free, 1024
            while len(codes) > 1:
                open_spots = spot + np.flatnonzero(~used[spot : spot + window])
                fits = ~used[open_spots[:, None] + (codes - codes[0])].any(axis=1)
                if fits.any():
                    spot = int(open_spots[fits.argmax()])
                    break
                spot, window = spot + window, window * 2
            base[place[node]] = spot - codes[0]
            for byte, child in children[node].items():
                at = int(base[place[node]]) + byte + 1
                used[at], check[at], piece[at] = True, place[node], values[child]
                place[child] = at
                waiting.append(child)
    end = int(np.flatnonzero(used)[-1]) + 512
    return base[:end], check[:end], piece[:end]


@lru_cache(maxsize=4)
def load_model(path: str = MODEL) -> Model:
    """Read pieces and scores of a SentencePiece model file with identity normalisation."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, scores, keys, bytes_from = [], [], {}, -1
    for at in range(processor.get_piece_size()):
        text, score = processor.id_to_piece(at), processor.get_score(at)
        scores.append(score)
        if processor.is_byte(at):
            bytes_from = at if bytes_from < 0 else bytes_from
            texts.append(bytes([at - bytes_from]))
        elif processor.is_control(at) or processor.is_unknown(at):
            texts.append(b"" if processor.is_control(at) else "⁇".encode())
        else:
            texts.append(text.replace(MARKER, " ").encode())
            if not processor.is_unused(at) and texts[-1]:
                keys[texts[-1]] = at
    base, check, piece = double_array(keys)
    known = set(b"".join(keys))
    breaks = np.array([byte < 0x80 and byte not in known for byte in range(256)])
    inner = any(b" " in key.lstrip(b" ") for key in keys)
    prefix = processor.decode(processor.encode("a")) == "a" and processor.id_to_piece(processor.encode("a")[0]).startswith(MARKER)
    return Model(texts, np.array(scores, float), processor.unk_id(), bytes_from, base, check, piece, breaks, not inner, prefix)


def _segments(data: np.ndarray, offsets: np.ndarray, model: Model) -> Words:
    """Cut texts where no piece can reach across: before runs of spaces and around bytes of no piece."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    cut = model.breaks[data]
    first[:-1] |= cut
    first[1:] |= cut
    if model.splits_at_space and len(data):
        space = data == 0x20
        first[1:-1] |= space[1:] & ~space[:-1]
    starts = np.flatnonzero(first[:-1])
    return Words(data, starts, np.concatenate([starts[1:], [len(data)]])[: len(starts)], np.searchsorted(starts, offsets))


def _viterbi(block: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The best pieces of each row of a padded byte table: ids in order, and how many per row."""
    rows, width = len(block), block.shape[1]
    best = np.full((rows, width + 1), -np.inf)
    best[:, 0] = 0
    taken = np.full((rows, width + 1), -1, np.int32)
    step = np.ones((rows, width + 1), np.int32)
    for start in range(width):
        live = np.flatnonzero((lengths > start) & (best[:, start] > -np.inf))
        if not len(live):
            continue
        origin = best[live, start]
        span = _WIDTHS[block[live, start]]
        whole = np.zeros(len(live), bool)
        at, state, length = np.arange(len(live)), np.zeros(len(live), np.int32), 0
        while len(at):
            inside = lengths[live[at]] > start + length
            at, state = at[inside], state[inside]
            if not len(at):
                break
            after = model.base[state] + block[live[at], start + length] + 1
            known = model.check[after] == state
            at, state = at[known], after[known]
            length += 1
            found = model.piece[state]
            ends = np.flatnonzero(found >= 0)
            if len(ends):
                one, ids = at[ends], found[ends]
                whole[one] |= span[one] == length
                total = origin[one] + model.scores[ids]
                better = total > best[live[one], start + length]
                row = live[one[better]]
                best[row, start + length] = total[better]
                taken[row, start + length] = ids[better]
                step[row, start + length] = length
        alone = np.flatnonzero(~whole)
        end = np.minimum(start + span[alone], lengths[live[alone]])
        total = origin[alone] + model.unknown_score
        better = total > best[live[alone], end]
        row, end = live[alone][better], end[better]
        best[row, end] = total[better]
        if model.bytes_from < 0:
            taken[row, end], step[row, end] = model.unknown, end - start
            continue
        # The bytes of an unknown character are traced back one by one.
        for length in range(1, 5):
            part = row[end - start >= length]
            if len(part):
                taken[part, start + length], step[part, start + length] = -1, 1
    owners, ids, place = [], [], lengths.copy()
    live = np.flatnonzero(place > 0)
    while len(live):
        found = taken[live, place[live]]
        as_byte = model.bytes_from + block[live, np.maximum(place[live] - 1, 0)].astype(np.int32)
        owners.append(live)
        ids.append(np.where(found >= 0, found, as_byte))
        place[live] -= step[live, place[live]]
        live = live[place[live] > 0]
    if not owners:
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    rounds = np.repeat(np.arange(len(owners)), [len(o) for o in owners])
    owner = np.concatenate(owners)
    order = np.lexsort((-rounds, owner))
    return np.concatenate(ids)[order].astype(np.int32), np.bincount(owner, minlength=rows)


def _matches(data: np.ndarray, count: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id) of all pieces at the first ``count`` places, by start; all places step through the trie at once."""
    at, state, length = np.arange(count), np.zeros(count, np.int32), 0
    starts, lengths, ids = [], [], []
    while len(at):
        inside = at + length < len(data)
        at, state = at[inside], state[inside]
        after = model.base[state] + data[at + length] + 1
        known = model.check[after] == state
        at, state = at[known], after[known]
        length += 1
        found = model.piece[state]
        ends = np.flatnonzero(found >= 0)
        starts.append(at[ends])
        lengths.append(np.full(len(ends), length))
        ids.append(found[ends])
    starts, lengths, ids = (np.concatenate(column) for column in (starts, lengths, ids))
    order = np.argsort(starts, kind="stable")
    return starts[order], lengths[order], ids[order]


def _viterbi_of_one(data: np.ndarray, model: Model) -> np.ndarray:
    """The best pieces of one long segment, with the same choices as :func:`_viterbi`; linear in its length.

    Scores are kept for one window of places at a time, and a piece and its length for every place.
    """
    size = len(data)
    taken, step = np.full(size + 1, -1, np.int32), np.ones(size + 1, np.int32)
    reach = max(len(text) for text in model.texts) + 4
    best = [0.0] + [-np.inf] * (WINDOW + reach)
    for begin in range(0, size, WINDOW):
        count = min(WINDOW, size - begin)
        part = data[begin : begin + count + reach]
        starts, lengths, ids = _matches(part, count, model)
        first = np.searchsorted(starts, np.arange(count + 1)).tolist()
        scores = model.scores[ids].tolist()
        lengths, ids, spans = lengths.tolist(), ids.tolist(), _WIDTHS[part[:count]].tolist()
        own, steps = taken[begin : begin + count + reach + 1].tolist(), step[begin : begin + count + reach + 1].tolist()
        for start in range(count):
            origin = best[start]
            if origin == -np.inf:
                continue
            whole = False
            for match in range(first[start], first[start + 1]):
                length = lengths[match]
                whole = whole or length == spans[start]
                total = origin + scores[match]
                if total > best[start + length]:
                    best[start + length], own[start + length], steps[start + length] = total, ids[match], length
            end = min(start + spans[start], size - begin)
            if not whole and origin + model.unknown_score > best[end]:
                best[end] = origin + model.unknown_score
                if model.bytes_from < 0:
                    own[end], steps[end] = model.unknown, end - start
                else:
                    for place in range(start + 1, end + 1):
                        own[place], steps[place] = -1, 1
        taken[begin : begin + len(own)], step[begin : begin + len(steps)] = own, steps
        best = best[count:] + [-np.inf] * count
    found, place = [], size
    while place > 0:
        found.append(taken[place] if taken[place] >= 0 else model.bytes_from + data[place - 1])
        place -= step[place]
    return np.array(found[::-1], np.int32)


def _best_pieces(words: Words, chosen: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their counts for the chosen segments, in blocks of similar length."""
    lengths = (words.ends - words.starts)[chosen]
    order = np.argsort(lengths, kind="stable")
    counts = np.zeros(len(chosen), np.int64)
    parts, at = [], 0
    while at < len(order):
        # Up to about 4 MB of bytes a block; a longer segment is a block of its own.
        longest = max(16, int(lengths[order[at]] * 1.25) + 1)
        stop = min(int(np.searchsorted(lengths[order], longest, "right")), at + max(1, (1 << 19) // longest))
        stop = max(stop, at + 1)
        rows = order[at:stop]
        width = int(lengths[rows].max())
        spread = words.starts[chosen[rows]][:, None] + np.arange(width)
        block = words.data[np.minimum(spread, len(words.data) - 1)]
        if len(rows) < FEW_ROWS and width > 8 * FEW_ROWS:
            # For a few long segments the steps over all rows at once would be longer than over one at a time.
            each = [_viterbi_of_one(block[at, : lengths[row]], model) for at, row in enumerate(rows)]
            found, number = np.concatenate(each), np.array([len(ids) for ids in each])
        else:
            found, number = _viterbi(block, lengths[rows], model)
        counts[rows] = number
        parts.append((rows, found))
        at = stop
    firsts = np.concatenate([[0], np.cumsum(counts)])
    ids = np.zeros(firsts[-1], np.int32)
    for rows, found in parts:
        number = counts[rows]
        ids[np.repeat(firsts[rows] - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(len(found))] = found
    return ids, counts


def encode_texts(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and the offsets between texts. NULL and empty texts have none."""
    raw = [(text or "").replace(MARKER, " ").encode("utf-8", "replace") for text in texts]
    if model.prefix:
        raw = [b" " + text if text else text for text in raw]
    offsets = np.concatenate([[0], np.cumsum([len(text) for text in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    words = _segments(data, offsets, model)
    _, chosen, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    ids, counts = _best_pieces(words, chosen, model)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    number = counts[which]
    ends = np.concatenate([[0], np.cumsum(number)])
    full = ids[np.repeat(firsts[which] - ends[:-1], number) + np.arange(ends[-1])]
    return full, ends[words.first]


def decode_ids(ids: np.ndarray, model: Model) -> str:
    """The text of piece ids: markers become spaces, byte pieces bytes, and the leading space is dropped."""
    raw = b"".join([model.texts[at] for at in ids.tolist()])
    if model.prefix and raw.startswith(b" "):
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


def encode(docs: DataFrame, keep: list[str] | None = None, path: str = MODEL) -> DataFrame:
    """The columns ``keep`` (default: all) and ``ids``, the piece ids of the whole ``text``.

    A narrow step: nothing is shuffled, and what is broadcast is the vocabulary. NULL and empty
    texts give an empty list; rows that repeat, ids that are NULL and an empty table are no special case. Time is linear
    in the text, with spaces or without. The whitespace marker itself, in a text, counts as a space, as in the format.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def ids_of(texts: pa.Array) -> list[pa.Array]:
        ids, offsets = encode_texts(texts.to_pylist(), model.value)
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]

    return map_texts(docs, ids_of, [T.StructField("ids", T.ArrayType(T.IntegerType()))], keep)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns but ``ids``, and ``decoded``, the text of ``ids``; NULL stays NULL."""
    model = encoded.sparkSession.sparkContext.broadcast(load_model(path))
    rest = [name for name in encoded.columns if name not in ("ids", "decoded")]
    packed = encoded.select(F.struct(F.lit(True).alias("__row"), *(F.col(f"`{name}`") for name in rest)).alias("row"), "ids")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                decode_ids(ids.values.to_numpy(zero_copy_only=False), model.value) if ids.is_valid else None
                for ids in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "decoded"])

    decoded = packed.mapInArrow(step, T.StructType([packed.schema["row"], T.StructField("decoded", T.StringType())]))
    return decoded.select(*(F.col(f"row.`{name}`") for name in rest), "decoded")


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Encode and decode every text: counts, digests of both sides, and whether they agree."""
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    full = encode(texts, ["doc_id", "digest"], path)
    counted = full.withColumns(
        {"n_ids": F.size("ids").cast("long"), "ids_crc32": F.crc32(F.array_join("ids", " ").cast("binary"))}
    )
    back = decode(counted, path)
    decoded = F.sha2("decoded", 256)
    return back.select(
        "doc_id", "n_ids", "ids_crc32", decoded.alias("decoded_sha256"), (decoded == F.col("digest")).alias("same")
    )
