"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Each round is two joins and aggregations over the edges, written to the shared folder; nothing is
collected.  Minima are combined before the shuffle, and the joins are plain equi-joins that adaptive
execution splits where a node has very many neighbours.  The number of rounds grows with the
logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineupkit.runtime import drop_stash, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) edges; returns distinct (u, v) with u > v."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    kept = both.where("v > u") if large else both
    moved = kept.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
    # Small edges point down: order each pair, drop loops and repeats.
    ordered = moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return ordered.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node in reach.

    ``edges`` has two columns of one orderable type.  Loops and nulls are ignored.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stash(now.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        big = stash(_star(now, large=True), "edges")
        new = stash(_star(big, large=False), "edges")
        drop_stash(big)
        drop_stash(now)
        now = new
        # The edges are stars around the smallest nodes once a round changes nothing.
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = after
    raise RuntimeError("components did not settle")
