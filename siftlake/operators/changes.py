"""Check only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.sources.tables import supported_files

SOURCES = {"staged": ["staged"], "working": ["working"], "all": ["staged", "working"]}


def changed_paths(changes: DataFrame, source: str = "all") -> DataFrame:
    """The distinct paths changed in the chosen source; ``all`` unites both."""
    return changes.filter(F.col("source").isin(*SOURCES[source])).select("path").distinct()


def existing_changes(existing: DataFrame, changes: DataFrame, source: str = "all") -> DataFrame:
    """Those of the existing files that are named in the changes.

    How they are joined is left to the engine, which knows sizes when the plan runs: a short list is broadcast, and
    for a longer one files that a Bloom filter of the list rules out are dropped before the shuffle.
    """
    return existing.join(changed_paths(changes, source), "path", "left_semi")


def select_changed(existing: DataFrame, changes: DataFrame | None, full: DataFrame, source: str = "all") -> DataFrame:
    """The files an incremental check covers.

    ``existing`` are all files of the repository, whatever their language, one row per path;
    ``full`` is what a complete check would cover. Without any existing changed file, or without
    a change list, the check covers everything. Changes that are all in unsupported languages
    do count: they leave nothing to check. Which of the two it is, is decided when the plan runs. Ignored names are not applied to changed files.
    """
    if changes is None:
        return full
    changed = existing_changes(existing, changes, source)
    # One row if nothing that exists was changed, else none; an empty side spares the full scan.
    nothing = changed.select("path").limit(1).agg(F.count("*").alias("__changed")).where("__changed = 0")
    everything = full.crossJoin(F.broadcast(nothing)).select(*full.columns)
    return supported_files(changed).select(*full.columns).unionByName(everything)
