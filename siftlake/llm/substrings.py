"""Removal of repeated passages by a relative Lempel-Ziv parse of documents against each other.

Every block of ``window`` consecutive words of every document can serve as a reference. A
document is parsed greedily, left to right: where a block also starts in a document with a smaller
id, a factor begins, and it grows as long as the next block stands one word further in the same reference.
A factor is thus one passage of its reference; it is at least a window long and is removed. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.words import packed, pieces, runs_of, signed, split_words, text_bytes
from siftlake.llm.scratch import Scratch

# Words per anchor: a block's anchor is the least hash among its runs of so many words.
ANCHOR_WORDS = 8

FACTORS = "array<struct<start:int,length:int,ref_id:long,ref_start:int>>"
_FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))

# A block with more than this share of all blocks' rows is joined by broadcast; there can be no more than its inverse.
HOT_BLOCKS = 4096


def block_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each block. Equal blocks have equal anchors, and neighbours mostly share one."""
    runs = runs_of(hashes, ANCHOR_WORDS)
    reach, width = window - ANCHOR_WORDS + 1, 1
    while width * 2 <= reach:
        runs, width = np.minimum(runs[:-width], runs[width:]), width * 2
    rest = reach - width
    return np.minimum(runs[: len(runs) - rest], runs[rest:]) if len(runs) > rest else runs[:0]


def _key(digest: str) -> int:
    """The first 64 bits of a digest."""
    return int(digest[:16], 16) - (1 << 63)


def _word_digest(text: str | None) -> str:
    return hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest()


def _survey(window: int):
    """Per document its word count and the digest of its words (kind 0); distinct anchors by key (kind 1)."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for piece in pieces(batches):
            texts = piece.column("text")
            found = split_words(texts)
            hashes = found.hashes()
            data, offsets = text_bytes(texts)
            whole = data.tobytes()
            names, anchors, owners = [], [], []
            if len(seen) > 1_000_000:
                seen.clear()
            for at, (start, end) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
                digest = hashlib.sha256(b" ".join(whole[offsets[at] : offsets[at + 1]].split()))
                names.append(digest.hexdigest())
                if end - start >= window and digest.digest() not in seen:
                    seen.add(digest.digest())
                    own = np.unique(block_anchors(hashes[start:end], window))
                    anchors.append(own)
                    owners.append(np.full(len(own), _key(names[-1]), np.int64))
            owners = np.concatenate([np.zeros(0, np.int64), *owners])
            rows, more = len(names), len(owners)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [rows, more]).astype(np.int32)),
                    pa.concat_arrays([piece.column("doc_id"), pa.nulls(more, pa.int64())]),
                    pa.concat_arrays([pa.array(names, pa.string()), pa.nulls(more, pa.string())]),
                    pa.array(np.concatenate([[_key(name) for name in names], owners]).astype(np.int64)),
                    pa.array(np.concatenate([found.counts(), np.zeros(more, np.int64)])),
                    pa.array(np.concatenate([np.zeros(rows, np.int64), *map(signed, anchors)])),
                ],
                ["kind", "doc_id", "digest", "key", "n", "anchor"],
            )

    return survey


def _blocks(window: int):
    """The blocks of each document whose anchors recur elsewhere: (block, doc_id, key of the text, start)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = split_words(piece.column("text"))
            hashes = found.hashes()
            columns = [[], [], [], []]
            for at, (start, end) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
                wanted = piece.column("anchors")[at].values.to_numpy(zero_copy_only=False).view(np.uint64)
                own = hashes[start:end]
                starts = np.flatnonzero(np.isin(block_anchors(own, window), wanted))
                columns[0].append(signed(runs_of(own, window)[starts]))
                columns[1].append(np.full(len(starts), piece.column("doc_id")[at].as_py(), np.int64))
                columns[2].append(np.full(len(starts), piece.column("key")[at].as_py(), np.int64))
                columns[3].append(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(column)) for column in columns], ["block", "doc_id", "key", "start"]
            )

    return blocks


def factors_of(hits: dict[str, np.ndarray], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, reference, start there) from the blocks with a reference, in order of ``start``.

    A factor goes on while block and reference both move on by one word of the same reference text.
    """
    starts, places = hits["start"], hits["ref_start"]
    if not len(starts):
        return []
    same = (np.diff(starts) == 1) & (np.diff(places) == 1) & (np.diff(hits["ref_id"]) == 0) & (np.diff(hits["ref_key"]) == 0)
    begin = np.concatenate([[0], np.flatnonzero(~same) + 1])
    size = np.diff(np.concatenate([begin, [len(starts)]])) + window - 1
    return list(zip(starts[begin].tolist(), size.tolist(), hits["ref_id"][begin].tolist(), places[begin].tolist()))


def _parse(window: int):
    """Factors, the number of covered words and the remaining words of each candidate document."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            factors, removed, kept, digests = [], [], [], []
            for text, hits in zip(piece.column("text").to_pylist(), piece.column("hits")):
                own = {n: hits.values.field(n).to_numpy(zero_copy_only=False) for n in ("start", "ref_id", "ref_key", "ref_start")}
                order = np.argsort(own["start"])
                found = factors_of({name: values[order] for name, values in own.items()}, window)
                words = text.encode().split()
                left = np.ones(len(words), bool)
                for start, length, *_ in found:
                    left[start : start + length] = False
                rest = b" ".join([words[at] for at in np.flatnonzero(left).tolist()])
                factors.append([dict(zip(("start", "length", "ref_id", "ref_start"), factor)) for factor in found])
                removed.append(int(len(words) - left.sum()))
                kept.append(rest.decode())
                digests.append(hashlib.sha256(rest).hexdigest())
            columns = [pa.array(factors, _FACTOR), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([piece.column("digest"), *columns], ["digest", "factors", "n_removed", "kept", "kept_sha256"])

    return parse


def _of_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only texts with the digest they were fetched for, once: a repeated id may bring others, and the same again."""
    seen: set[str] = set()
    for batch in batches:
        kept = []
        for text, digest in zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist()):
            kept.append(digest not in seen and _word_digest(text) == digest)
            if kept[-1]:
                seen.add(digest)
        if len(seen) > 1_000_000:
            seen.clear()
        yield batch.filter(pa.array(kept, pa.bool_()))


def _block_hits(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, start, ref) of the blocks that also start in a document with a smaller id.

    The reference of a block is its first place in the smallest document that has it. Blocks are counted before their
    shuffle. One that makes up over 1 / HOT_BLOCKS of all rows would fill its task in the join; there can be at most
    HOT_BLOCKS of these, so they are broadcast instead (some 200 kB).
    """
    ref = F.struct(F.col("doc_id").alias("ref_id"), F.col("key").alias("ref_key"), F.col("start").alias("ref_start"))
    refs = blocks.groupBy("block").agg(F.min(ref).alias("ref"), F.max("doc_id").alias("most"), F.count("*").alias("rows"))
    refs = scratch.write(refs.where("ref.ref_id < most").select("block", "ref", "rows"), "passages-refs")
    limit = blocks.count() // HOT_BLOCKS
    hot, rest = refs.where(F.col("rows") > limit), refs.where(F.col("rows") <= limit)
    common = F.broadcast(hot.select("block", "ref"))
    found = blocks.join(common, "block").unionByName(blocks.join(common.select("block"), "block", "left_anti").join(rest.select("block", "ref"), "block"))
    return found.where("doc_id > ref.ref_id").select("key", "start", "ref")


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50
) -> tuple[DataFrame, DataFrame]:
    """Parse all documents; returns (per document, per parsed text).

    The first table has one row per input row: ``doc_id``, ``digest`` (SHA-256 of the words joined
    by one space), ``n_words``, ``copy`` (whether the same words in the same order stand in a
    document with a smaller id, and form at least one window). The second has a row for every
    digest with factors: ``factors``, ``n_removed``, ``kept`` (the words left) and ``kept_sha256``.
    A copy is one factor as a whole and needs no parse; only the first document of
    each digest is parsed.

    * Each block has an anchor, the least hash among its eight-word runs. Only about one word in 22
      becomes an anchor, and a block can only recur where its anchor does. Documents are first
      matched by anchors; the blocks themselves are hashed and compared only where anchors
      recur, in the texts that hold them.
    * A text is parsed once, however many rows have it, and a block that very many texts
      share is matched by broadcast.

    NULL and empty texts have no words. Documents with a NULL id are never parsed nor used as
    references. Rows that repeat an id do not refer to each other, as neither id is smaller; each of
    their texts is parsed on its own.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "kind int, doc_id long, digest string, key long, n long, anchor long"
    survey = scratch.write(base.mapInArrow(_survey(window), schema), "passages-survey")
    members = survey.where("kind = 0").select("doc_id", "digest", "key", F.col("n").alias("n_words"))
    members = scratch.write(members, "passages-documents")
    firsts = members.where("doc_id is not null").groupBy("key", "digest").agg(F.min("doc_id").alias("first_id"))
    anchors = survey.where("kind = 1").select("key", "anchor")
    shared = anchors.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    shared = shared.where("least < most").select("anchor")
    wanted = anchors.join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    wanted = wanted.join(firsts, "key").select(F.col("first_id").alias("doc_id"), "key", "digest", "anchors")
    texts = base.where("text is not null").join(wanted, "doc_id").select("doc_id", "key", "digest", "text", "anchors")
    texts = scratch.write(texts.mapInArrow(_of_digest, texts.schema), "passages-texts")

    # An id may have several texts, so block starts go by the key of the text they were found in.
    blocks = texts.select("doc_id", "key", "text", "anchors")
    blocks = scratch.write(blocks.mapInArrow(_blocks(window), "block long, doc_id long, key long, start int"), "passages-blocks")
    # A set, as a text met in several tasks brings its blocks from each; it holds one row per word of one text.
    hits = _block_hits(blocks, scratch).groupBy("key").agg(F.collect_set(F.struct("start", "ref.*")).alias("hits"))
    parsed = texts.drop("anchors").join(hits, "key").select("digest", "text", "hits")
    parsed = parsed.mapInArrow(
        _parse(window), f"digest string, factors {FACTORS}, n_removed long, kept string, kept_sha256 string"
    )
    parsed = scratch.write(parsed.dropDuplicates(["digest"]), "passages-parsed")
    scratch.discard(*(table for table, _ in scratch.folders if table is not members and table is not parsed))
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    documents = members.join(firsts.select("digest", "first_id"), "digest", "left").withColumn("copy", F.coalesce(copy, F.lit(False)))
    return documents.select("doc_id", "digest", "n_words", "copy"), parsed


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def removal_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per document: ``n_words``, ``n_removed`` and ``kept_sha256``, the digest of the words kept."""
    documents, parsed = repeated_passages(docs, window=window)
    full = documents.join(parsed.select("digest", "n_removed", "kept_sha256"), "digest", "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.lit(EMPTY_DIGEST)).otherwise(F.coalesce("kept_sha256", "digest"))
    return full.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents with repeated passages removed; the others keep their text as it is.

    A text of which something was removed becomes its remaining words joined by one space.
    """
    documents, parsed = repeated_passages(docs, window=window)
    found = documents.join(parsed.select("digest", "kept"), "digest", "left").where("copy or kept is not null")
    found = found.select("doc_id", "digest", F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"))
    # Rows of one id may have different texts; each takes what was kept of its own.
    found = found.groupBy("doc_id", "digest").agg(F.min("kept").alias("kept"))
    text = F.col("text").cast("string")
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    rest = [name for name in docs.columns if name != "text"]
    full = docs.select("doc_id", packed(rest).alias("row"), "text", F.sha2(words, 256).alias("digest"))
    full = full.join(found, ["doc_id", "digest"], "left").withColumn("text", F.coalesce("kept", "text"))
    return full.select(*(F.col("text") if name == "text" else F.col(f"row.`{name}`") for name in docs.columns))
