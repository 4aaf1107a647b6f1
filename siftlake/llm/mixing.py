"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"

# Documents of a source are ordered by a seeded hash; this many of its hex digits choose a slice.
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the rank of a source from 0."""
    return (rank % 3 + 1).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weight=default_weight) -> DataFrame:
    """``source``, ``source_size``, ``target`` from (source, size) rows.

    The words of all sources are shared out by weight. A source takes at most ``max_epochs``
    times its size; what is left over is shared among the others by weight, until no source
    exceeds its cap. In the order of cap per weight, a source is capped exactly if its cap is below
    its share of what the sources before it left, so one pass with running sums finds the fixed
    point of that redistribution. It takes one row per source, after partial sums in every task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    exact = "decimal(19,0)"
    ranked = totals.withColumn("weight", weight(F.row_number().over(by_name) - 1).cast("decimal(18,0)"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast(exact))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "left": F.sum("source_size").over(everything).cast(exact) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(exact),
            "weights": F.sum("weight").over(after).cast("decimal(18,0)"),
        }
    )
    ranked = ranked.withColumn(
        "capped", F.col("cap") * F.col("weights") <= F.col("left").cast(exact) * F.col("weight")
    )
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    rest = F.max(F.when(~F.col("capped"), F.col("left"))).over(everything)
    share = F.col("weight").cast("double") * rest.cast("double") / open_weight.cast("double")
    return ranked.select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def _planned(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    source_column: str,
    max_epochs: int,
    seed: int,
    weight,
    carried: Sequence[str] = (),
) -> DataFrame:
    """The rows of ``mix_plan``, each with the columns ``carried`` of its own row as the struct ``row``."""
    number, text = F.col(id_column).cast("string"), F.col(text_column)
    # Rows without an id are placed by their texts, so that they do not all lie in one slice.
    own = F.coalesce(number, F.concat(F.lit("text:"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        # Never NULL, so that the window and the join below deal rows by the same keys and shuffle them once.
        F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("")).alias("origin"),
        word_count(text).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), own)).alias("place"),
        F.xxhash64(text).alias("tie"),
        *([F.struct(*(F.col(f"`{name}`") for name in carried)).alias("row")] if carried else []),
    )
    rows = rows.withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    targets = source_targets(rows.select("source", "size"), max_epochs, weight)
    slices = rows.groupBy("source", "origin", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    plan = slices.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.select("origin", "slice", "base", "source_size", "target", whole.cast("long").alias("repeats"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long"))
    within = Window.partitionBy("origin", "slice").orderBy("place", "doc_id", "size", "tie")
    placed = rows.withColumn("inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    full = placed.join(plan, ["origin", "slice"])
    start = F.col("base") + F.coalesce("inner", F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - start))
    return full.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("repeats") * F.col("size") + part).alias("taken"),
        "repeats",
        part.alias("part"),
        *(["row"] if carried else []),
    )


def mix_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    max_epochs: int = 3,
    seed: int = 0,
    weight=default_weight,
) -> DataFrame:
    """How much of every document the mix takes: one row per document.

    Columns: ``doc_id``, ``size`` (words; NULL text: 0), ``source_size``, ``target``, ``taken``,
    ``repeats`` (whole repetitions) and ``part`` (words of one more, partial repetition).

    Every document of a source is repeated floor(target / source size) times. The rest of the
    target is filled with documents in the order of a seeded hash of their ids; the last of them is cut,
    so a source's ``taken`` add up to its rounded target. The order's running sum is
    built from per-slice totals, so no source, however large, is sorted in one task. Only sizes, ids
    and sources are shuffled, never texts.

    NULL is a source of its own. Empty documents, and sources of only empty documents, take
    nothing. Rows that repeat an id follow each other by size and a hash of their texts; rows without an id are placed by a
    seeded hash of their texts.
    """
    return _planned(docs, id_column, text_column, source_column, max_epochs, seed, weight)


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mixed corpus: every document in its repetitions, with the columns of ``docs``.

    A partial repetition is a row with the document's first words, joined by one space. Every row
    follows its own row of ``mix_plan``, whether its id is repeated or NULL: rows travel through the plan with
    their texts, which are shuffled once. Rows without words are taken no times; an empty table gives no rows, and
    columns may have any names.
    """
    plan = _planned(docs, "doc_id", "text", "source", max_epochs, seed, default_weight, docs.columns).where("taken > 0")
    whole = F.when(F.col("repeats") > 0, F.array_repeat(F.lit(-1).cast("long"), F.col("repeats").cast("int")))
    part = F.when(F.col("part") > 0, F.array(F.col("part")))
    none = F.array().cast("array<long>")
    copies = F.concat(F.coalesce(whole, none), F.coalesce(part, none))
    rows = plan.select("row", F.explode(copies).alias("taken"))
    words = F.filter(F.split(F.col("row.text").cast("string"), "[\\x20\\x09-\\x0D]+"), lambda word: word != "")
    cut = F.array_join(F.slice(words, 1, F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") < 0, F.col("row.text")).otherwise(cut)
    return rows.select(*(text.alias("text") if name == "text" else F.col(f"row.`{name}`") for name in docs.columns))
