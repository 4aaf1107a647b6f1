"""Lists of changed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_changed_paths(lists: DataFrame, raw: str = "raw", source: str = "source") -> DataFrame:
    """One row per named path of newline-separated lists; blank lines are dropped."""
    lines = lists.select(source, F.explode(F.split(raw, "\n")).alias("line"))
    path = F.regexp_replace("line", r"(?U)\A\s+|\s+\z", "")
    return lines.select(path.alias("path"), F.col(source).alias("source")).filter(F.length("path") > 0)
