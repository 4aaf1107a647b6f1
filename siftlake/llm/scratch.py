"""Intermediate tables in the shared folder, emptied when nothing reads them any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.session import shared_dir


class Scratch:
    """Tables of one operator: written once, so that a lost executor costs no step that is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folders: list[tuple[DataFrame, str]] = []

    def write(self, table: DataFrame, name: str) -> DataFrame:
        target = shared_dir(self.spark, name)
        table.write.parquet(target)
        written = self.spark.read.parquet(target)
        self.folders.append((written, target))
        return written

    def discard(self, *tables: DataFrame) -> None:
        """Empty the folders of tables that no later step reads; without tables, all of them."""
        gone = [(table, target) for table, target in self.folders if not tables or any(table is t for t in tables)]
        self.folders = [pair for pair in self.folders if not any(pair[0] is table for table, _ in gone)]
        for _, target in gone:
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(target)
