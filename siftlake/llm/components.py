"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.scratch import Scratch


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Smallest node reachable from each linked node, as (node, component).

    Every round replaces links by links to smaller nodes (large star, then small star) until
    nothing changes; the number of rounds grows with the logarithm of the longest path. Each
    round is written to the shared folder, so lineage stays short and a lost executor costs one
    round. Per-node minima are aggregated before their shuffle, and the joins contain no
    aggregation above them, so a node with very many links can be split.
    """
    scratch = Scratch(links.sparkSession)
    a, b = F.col(left), F.col(right)
    pairs = links.where(a.isNotNull() & b.isNotNull() & (a != b))
    pairs = pairs.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("parent")).distinct()
    state = before = None
    while True:
        pairs = scratch.write(pairs, "links")
        if before is not None:
            scratch.discard(before)
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("node", "parent").cast("decimal(20,0)"))).first()
        if seen == state or not seen[0]:
            break
        state, before = seen, pairs
        pairs = _small_star(_large_star(pairs))
    own = pairs.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return pairs.select("node", F.col("parent").alias("component")).unionByName(own)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = pairs.unionByName(pairs.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("parent")).alias("least"))
    larger = pairs.select(F.col("parent").alias("node"), F.col("node").alias("other"))
    moved = larger.join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("parent"))
    return moved.distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, move to the smallest of them."""
    least = pairs.groupBy("node").agg(F.min("parent").alias("least"))
    moved = pairs.join(least, "node").where(F.col("parent") != F.col("least"))
    moved = moved.select(F.col("parent").alias("node"), F.col("least").alias("parent"))
    return moved.unionByName(least.select("node", F.col("least").alias("parent"))).distinct()
