"""Check on save: scan a stream of file versions and keep the latest diagnostics per path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlake.model import Rule
from siftlake.operators.scan import findings_of_hits, scan, scan_hits
from siftlake.sources.tables import supported_files

# How long a path counts as current after its last save.
KEEP_FOR = "30 days"
# Micro-batches between two compactions, and so the most folders of recent changes.
SLOTS = 16

_HITS = "path string, file_id string, language string, ord bigint, lines array<bigint>, version_ts timestamp"


def scan_versions(versions: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of saved files in a supported language; stateless, so it works in append mode."""
    return scan(supported_files(versions), rules)


def start_scan(versions: DataFrame, rules: Sequence[Rule], table: str, progress: str) -> StreamingQuery:
    """Append the findings of all versions that have arrived to a parquet table, then stop."""
    writer = scan_versions(versions, rules).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", progress).trigger(availableNow=True).start(table)


def _newest() -> Column:
    """The whole newest version of a path, by time and then by id."""
    return F.max_by(F.struct("file_id", "language", "ord", "lines", "version_ts"), F.struct("version_ts", "file_id"))


def newest_versions(versions: DataFrame, rules: Sequence[Rule], keep_for: str = KEEP_FOR) -> DataFrame:
    """The hits of the newest version of every path and period of length ``keep_for``, for streams and tables alike.

    The state is one row per path and period: the lines found, not the text. A newer version
    without findings has a row too, so it clears the findings of the older one. Rows of periods that ended
    ``keep_for`` before the newest save seen are dropped, so the state holds the paths of the last
    two periods or so, however long the stream runs.
    """
    hits = scan_hits(supported_files(versions), rules, keep=["version_ts"]).withWatermark("version_ts", keep_for)
    period = F.window("version_ts", keep_for)
    return hits.groupBy("path", period).agg(_newest().alias("newest")).select("path", "newest.*")


def _current(newest: DataFrame, keep_for: str) -> DataFrame:
    """One row per path: its newest version, unless that is older than the newest of all by more than ``keep_for``."""
    paths = newest.where("path is not null").groupBy("path").agg(_newest().alias("newest")).select("path", "newest.*")
    last = newest.agg(F.max("version_ts").alias("__last"))
    kept = paths.join(F.broadcast(last), F.col("version_ts") >= F.col("__last") - F.expr(f"interval {keep_for}"))
    return kept.select(*newest.columns)


def latest_hits(versions: DataFrame, rules: Sequence[Rule], keep_for: str = KEEP_FOR) -> DataFrame:
    """The hits of the newest version of every current path of a table of versions."""
    return _current(newest_versions(versions, rules, keep_for), keep_for)


def _stored(spark: SparkSession, table: str, name: str) -> DataFrame:
    return spark.read.schema(f"{_HITS}, batch bigint").parquet(f"{table}/{name}")


def _prepare(spark: SparkSession, table: str) -> None:
    """An empty table, where there is none yet. Every base has a row without a path that names its last batch."""
    marker = spark.createDataFrame([(None, None, None, None, None, None, -1)], f"{_HITS}, batch bigint")
    marker.coalesce(1).write.mode("ignore").parquet(f"{table}/base/side=1")
    marker.limit(0).coalesce(1).write.mode("ignore").parquet(f"{table}/recent/slot=-1")


def _compact(spark: SparkSession, table: str, batch: int, keep_for: str) -> None:
    """Merge the base and all recent changes into the other base; the slots are then free.

    A run that ends half-way is repeated with its micro-batch, from tables that are still whole.
    """
    turn = batch // SLOTS
    old = _stored(spark, table, f"base/side={(turn - 1) % 2}").unionByName(_stored(spark, table, "recent"), allowMissingColumns=True)
    kept = _current(old.drop("batch", "slot"), keep_for)
    marker = spark.createDataFrame([(None,) * 6], _HITS)
    base = kept.unionByName(marker).withColumn("batch", F.lit(batch).cast("bigint"))
    base.write.mode("overwrite").parquet(f"{table}/base/side={turn % 2}")


def start_latest(
    versions: DataFrame, rules: Sequence[Rule], table: str, progress: str, keep_for: str = KEEP_FOR
) -> StreamingQuery:
    """Keep the current diagnostics of all paths in ``table``, then stop when all is read.

    A micro-batch writes the paths it changed to one of SLOTS folders, which it replaces, so one that is repeated
    after a failure leaves the same rows. When all folders are taken they are merged into a base without the
    paths that are no longer current; there are never more than two bases.
    """
    _prepare(versions.sparkSession, table)

    def save(changed: DataFrame, batch: int) -> None:
        numbered = changed.withColumn("batch", F.lit(batch).cast("bigint"))
        numbered.write.mode("overwrite").parquet(f"{table}/recent/slot={batch % SLOTS}")
        if batch % SLOTS == SLOTS - 1:
            _compact(changed.sparkSession, table, batch, keep_for)

    writer = newest_versions(versions, rules, keep_for).writeStream.outputMode("update").foreachBatch(save)
    return writer.option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, table: str, rules: Sequence[Rule], keep_for: str = KEEP_FOR) -> DataFrame:
    """The current findings per path, from what ``start_latest`` has written: the newer base, and what came after it."""
    base, recent = (_stored(spark, table, name).drop("side", "slot") for name in ("base", "recent"))
    through = F.broadcast(base.agg(F.max("batch").alias("__through")))
    rows = base.join(through, F.col("batch") == F.col("__through")).drop("__through")
    rows = rows.unionByName(recent.join(through, F.col("batch") > F.col("__through")).drop("__through"))
    return findings_of_hits(_current(rows.drop("batch"), keep_for), rules)
