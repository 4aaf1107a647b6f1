"""Contiguous shards of nearly equal bytes, cut from global prefix sums of per-slice totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import shared_dir

# Slices of the common order, by the leading bits of a text's hash. Their totals are the only rows summed up in
# one task: 16384, however large the corpus.
SLICE_BITS = 14
# Documents with equal texts are numbered in so many parts, so that no task holds all copies of one text.
PARTS = 1024
# Copies of a text stay together unless they fill more than this share of a shard.
WHOLE_GROUP = 0.05


def byte_shards(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 8) -> DataFrame:
    """Place every row in a shard: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``.

    Rows are put in one global order, by a hash of the text and then of the id, so equal texts are
    neighbours. Sizes (UTF-8 bytes and 1) are summed per slice of that order, the slice totals
    give every slice its first byte, and sums within a slice every row its own. A row belongs to the
    shard in which its middle byte falls when all bytes are cut into equal targets; the copies of one text go
    together by the middle of the group, unless the group is larger than ``WHOLE_GROUP`` of a
    shard. Shards are therefore contiguous and differ by little more than that share, and ``slot`` numbers the rows of each from 0.

    No text is shuffled. NULL texts count as empty. Rows that repeat id and text get slots one after the other; a
    NULL id is an id like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
    )
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    group, cell = ["hash", "crc", "size"], ["hash", "crc", "size", "part"]

    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    cells = cells.withColumn("slice", F.shiftright("hash", 64 - SLICE_BITS))
    totals = cells.groupBy("slice").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "slice",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    in_slice = Window.partitionBy("slice").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    in_group = Window.partitionBy("slice", *group)
    bytes_of = F.col("n") * F.col("size")
    starts = cells.withColumns(
        {
            "rows_inside": F.coalesce(F.sum("n").over(in_slice), F.lit(0)),
            "bytes_inside": F.coalesce(F.sum(bytes_of).over(in_slice), F.lit(0)),
            "group_bytes": F.sum(bytes_of).over(in_group),
        }
    )
    starts = starts.withColumn("group_inside", F.min("bytes_inside").over(in_group))
    starts = starts.join(F.broadcast(totals), "slice").select(
        *cell,
        (F.col("rows_before") + F.col("rows_inside")).alias("first_row"),
        (F.col("bytes_before") + F.col("bytes_inside")).alias("first_byte"),
        (F.col("bytes_before") + F.col("group_inside")).alias("group_byte"),
        "group_bytes",
        "all_bytes",
    )
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id")) - 1
    placed = rows.withColumn("number", number.cast("long")).join(starts, cell)
    together = F.col("group_bytes") * shards <= F.col("all_bytes") * WHOLE_GROUP
    own = F.col("first_byte") + F.col("number") * F.col("size")
    doubled = F.when(together, 2 * F.col("group_byte") + F.col("group_bytes")).otherwise(2 * own + F.col("size"))
    placed = placed.withColumn("doubled", doubled)
    placed = placed.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.expr(f"cast((doubled * {shards}) div (2 * all_bytes) as int)").alias("shard"),
        (F.col("first_row") + F.col("number")).alias("row"),
    )
    target = shared_dir(spark, "shards")
    placed.write.parquet(target)
    placed = spark.read.parquet(target)
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    full = placed.join(F.broadcast(firsts), "shard")
    return full.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
