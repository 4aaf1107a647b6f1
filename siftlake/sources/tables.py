"""Text tables as files: any table with an id and a text column can be scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.paths import language_of

# Below this much input per core, the time to shuffle a table is smaller than the time
# lost by scanning its few row groups on few cores.
SMALL_BYTES_PER_CORE = 16 << 20


def files_from_table(
    table: DataFrame,
    file_id: str | Column,
    text: str | Column,
    path: str | Column | None = None,
    ord: str | Column | None = None,
) -> DataFrame:
    """Read a table as files. Rows without a path have no language.

    ``ord`` orders the files in reports and decides between equally bad ones. Without it, numeric
    ids give the order, and other ids a fixed one of their own; neither needs a shuffle.
    """

    def column(value: str | Column) -> Column:
        return F.col(value) if isinstance(value, str) else value

    name = column(file_id).cast("string")
    location = F.lit(None).cast("string") if path is None else column(path)
    order = F.coalesce(name.try_cast("bigint"), F.xxhash64(name)) if ord is None else column(ord).cast("bigint")
    return table.select(
        name.alias("file_id"),
        location.alias("path"),
        (F.lit(None).cast("string") if path is None else language_of(location)).alias("language"),
        column(text).alias("text"),
        order.alias("ord"),
    )


def supported_files(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Files in a supported language, or in one of the given ones."""
    kept = files.filter(F.col("language").isNotNull())
    return kept.filter(F.col("language").isin(*languages)) if languages else kept


def spread_tasks(table: DataFrame, growth: int = 1) -> int:
    """How many tasks to spread a small table over; 0 for a large one."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return cores * 2 if size < cores * SMALL_BYTES_PER_CORE * growth else 0


def spread_small(table: DataFrame, key: str, growth: int = 1) -> DataFrame:
    """Spread a small table over all cores by a unique key; leave a large one as it is read.

    A parquet row group is read by one task. A small table often is a single row group, which
    would leave all other cores idle; a large one has enough of them, and is never shuffled. A table
    from whose rows larger ones are made counts as small up to ``growth`` times that size.
    """
    tasks = spread_tasks(table, growth)
    return table.repartition(tasks, key) if tasks else table
