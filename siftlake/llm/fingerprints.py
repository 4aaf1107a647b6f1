"""Document fingerprints of closed syncmers over words.

A run of k words is an anchor if the least hash among its words is that of its first or last one.
Whether it is depends on the run alone, so equal passages yield equal anchors wherever they
stand, and any k - 1 consecutive runs hold at least one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.scratch import Scratch

RUN = 5
# Runs say little about a text of fewer words.
SHORT = 16
# A run of this many characters without white space is cut into several words.
WORD = "[^\\x20\\x09-\\x0D]{1,16}"
# Slices of the ids that the order of documents is built from.
SLICES = 1024
_COARSE = 32


def _with_anchors(table: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: anchors in text order, as 40-bit numbers of a run's hash and the distance to the anchor before.

    In a text of fewer than SHORT words every word is an anchor; one without words has none.
    """
    hashes = F.expr(f"transform(regexp_extract_all({text}, '{WORD}', 0), w -> xxhash64(w))".replace("\\x", "\\\\x"))
    table = table.withColumn("__h", hashes).withColumn("__n", F.size("__h"))
    inner = ", ".join(f"get(__h, i + {at})" for at in range(1, RUN - 1))
    edge = f"least(get(__h, i), get(__h, i + {RUN - 1})) <= least({inner})"
    chosen = f"filter(sequence(0, __n - {RUN}), i -> {edge})"
    places = f"case when __n >= {SHORT} then {chosen} when __n > 0 then sequence(0, __n - 1) else array() end"
    table = table.withColumn("__p", F.expr(f"cast({places} as array<int>)"))
    run = "xxhash64(" + ", ".join(f"get(__h, p + {at})" for at in range(RUN)) + ")"
    run = f"if(__n >= {SHORT}, {run}, get(__h, p))"
    anchor = f"shiftleft({run} & 4294967295, 8) | least(255, p - if(j = 0, 0, get(__p, j - 1)))"
    return table.withColumn(name, F.expr(f"transform(__p, (p, j) -> {anchor})")).drop("__h", "__n", "__p")


def fingerprint_text(anchors: str) -> Column:
    """Ten hex digits per anchor, in text order."""
    return F.expr(f"array_join(transform({anchors}, a -> lpad(lower(hex(a)), 10, '0')), '')")


def likeness(one: str, other: str) -> Column:
    """Share of common anchors among all distinct ones, matched by hash and relative position; 1 if there are none."""
    both = F.size(F.array_intersect(one, other))
    every = F.size(F.array_distinct(one)) + F.size(F.array_distinct(other)) - both
    return F.when(every > 0, both / every).otherwise(F.lit(1.0))


def next_ids(ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Each distinct id and the next larger one; the first follows the last.

    Ids are cut at quantiles into slices and ordered within each; a table of one row per slice links
    the slices, so no task sorts all ids. The quantiles, SLICES numbers at most, are the only
    ones that pass through the driver.
    """
    ids = ids.select(F.col(id_column).alias("id")).where("id is not null").distinct()
    shares = [at / SLICES for at in range(1, SLICES)]
    cuts = ids.agg(F.percentile_approx("id", shares, 20 * SLICES)).first()[0] or []
    cuts = sorted(set(cuts))
    groups = [cuts[at : at + _COARSE] for at in range(0, len(cuts), _COARSE)]
    if not groups:
        return ids.select("id", F.col("id").alias("next_id"))
    tops = "array(" + ", ".join(f"{group[0]}L" for group in groups) + ")"
    inner = "array(" + ", ".join("array(" + ", ".join(f"{cut}L" for cut in group) + ")" for group in groups) + ")"
    coarse = f"size(filter({tops}, c -> c <= id))"
    ids = ids.withColumn("coarse", F.expr(coarse))
    fine = f"if(coarse = 0, 0, {_COARSE} * (coarse - 1) + size(filter(get({inner}, coarse - 1), c -> c <= id)))"
    ids = ids.select("id", F.expr(fine).alias("slice"))
    firsts = ids.groupBy("slice").agg(F.min("id").alias("first"))
    linked = firsts.select(
        "slice",
        F.coalesce(F.lead("first").over(Window.orderBy("slice")), F.min("first").over(Window.partitionBy())).alias("after"),
    )
    ids = ids.withColumn("next", F.lead("id").over(Window.partitionBy("slice").orderBy("id")))
    return ids.join(F.broadcast(linked), "slice").select("id", F.coalesce("next", "after").alias("next_id"))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited versions, one row per input row.

    In the edited version, the last quarter of the characters is replaced by as many from the
    start of the text with the next larger id. Columns: ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Texts are shuffled once, by id, for both joins; what travels on to the document before is the
    part of a text that it needs, and the anchors. NULL texts are empty. If several rows share an
    id, the one with the smallest text hash is what the document before continues with. Rows
    without an id have no next document: their last quarter is cut off, and ``near_next`` compares with nothing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if (id_column, text_column) != ("doc_id", "text"):
        docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    # A cast, even to the same type, would hide from Spark that both joins read the same.
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    base = docs.select("doc_id", text.alias("text"))
    known = base.where("doc_id is not null")
    ids = known.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"), F.min(F.xxhash64("text")).alias("hash"))
    ids = Scratch(docs.sparkSession).write(ids, "fingerprint-ids")
    order = next_ids(ids, "doc_id")
    wanted = ids.select("doc_id", "n").join(order, F.col("doc_id") == F.col("id"))
    wanted = wanted.select(F.col("doc_id").alias("for_id"), F.expr("cast(n div 4 as int)").alias("length"), "next_id")
    wanted = wanted.join(ids.select(F.col("doc_id").alias("next_id"), "hash"), "next_id")

    # As a difference, the hash is no key of the join, and both joins share the texts' shuffle by id.
    same = F.xxhash64("text").bitwiseXOR(F.col("hash")) == 0
    heads = known.join(wanted, F.col("doc_id") == F.col("next_id")).where(same)
    heads = _with_anchors(heads.select("for_id", "length", "text"), "text", "next_anchors")
    heads = heads.select("for_id", F.expr("left(text, length)").alias("head"), "next_anchors")
    # Rows repeated in full bring the same head twice.
    once = Window.partitionBy("for_id").orderBy("for_id")
    heads = heads.withColumn("__once", F.row_number().over(once)).where("__once = 1").drop("__once")

    full = known.join(heads, F.col("doc_id") == F.col("for_id")).select("doc_id", "text", "head", "next_anchors")
    none = F.array().cast("array<long>")
    lost = base.where("doc_id is null").select("doc_id", "text", F.lit("").alias("head"), none.alias("next_anchors"))
    full = full.unionByName(lost)
    full = _with_anchors(full.withColumn("n_chars", F.char_length("text").cast("long")), "text", "anchors")
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 4 as int)), left(head, cast(n_chars div 4 as int)))")
    full = full.withColumn("edited", edited).drop("text", "head")
    full = _with_anchors(full, "edited", "edited_anchors")
    return full.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text("anchors").alias("fingerprint"),
        fingerprint_text("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )
