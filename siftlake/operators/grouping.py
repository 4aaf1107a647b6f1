"""Bounded groups: split the rows of a key that has very many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = 1000


def in_parts(rows: DataFrame, key: str, limit: int, columns: Sequence[str]) -> DataFrame:
    """Number the rows of each key into parts of about ``limit`` rows, in a ``part`` column.

    Keys with at most ``limit`` rows stay whole, in part 0. Nothing is dropped, and no task
    holds all rows of a large key: equal rows are first counted, which Spark does before the
    shuffle; sizes come from that count; and the part is found by a join that is salted, so
    that even a key with most of the rows is spread over all tasks.
    """
    salts = max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = rows.select(key, *columns).groupBy(key, *columns).agg(F.count(F.lit(1)).alias("__copies"))
    sizes = counted.groupBy(key).agg(F.sum("__copies").alias("__size"))
    large = sizes.filter(F.col("__size") > limit).select(
        key,
        F.ceil(F.col("__size") / limit).alias("__parts"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"),
    )
    # Copies come back in blocks, so that even millions of equal rows are never one array.
    block_count = F.floor((F.col("__copies") - 1) / _BLOCK)
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), block_count)))
    in_block = F.least(F.lit(_BLOCK), F.col("__copies") - F.col("__block") * _BLOCK)
    copies = blocks.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), in_block)))
    row_hash = F.xxhash64(*columns, "__block", "__copy")
    salted = copies.withColumn("__hash", row_hash).withColumn("__salt", F.pmod("__hash", F.lit(salts)).cast("int"))
    joined = salted.join(large, [key, "__salt"], "left")
    # A second, independent hash: rows of one salt must not end up in the same few parts.
    part = F.pmod(F.xxhash64("__hash", F.lit("part")), F.col("__parts"))
    return joined.select(key, *columns, F.coalesce(part, F.lit(0)).cast("bigint").alias("part"))
