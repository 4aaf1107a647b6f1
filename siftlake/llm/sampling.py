"""Bounded, labelled samples to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> tuple[DataFrame, float]:
    """At most ``rows`` texts of either class as (text, label), and the share of class 1 among all usable labels.

    Only labels of ids that ``docs`` holds are drawn from, in the order of a hash of their ids. Of an id with several
    texts the one with the least hash is taken, once. Ids with contradicting labels, or without one, are left out. The chosen
    ids are broadcast: 24 bytes each, at most 2 * ``rows`` of them.
    """
    known = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
    known = known.where("label = other").select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    held = texts.groupBy("doc_id").agg(F.min("digest").alias("digest")).join(known, "doc_id")
    order = F.xxhash64("doc_id")
    one, other = (held.where(F.col("label") == at).orderBy(order, "doc_id").limit(rows) for at in (1, 0))
    chosen = texts.join(F.broadcast(one.unionByName(other)), ["doc_id", "digest"])
    # Rows that repeat an id and a text are merged in the tasks that read them.
    return chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"), share
