"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the least node that it reaches.

    Each round links a node's neighbours to the least of them, so the number of rounds grows with the logarithm of the
    longest chain; they end as soon as all edges are stars. Rows stay at or below those of the edges; a hub's neighbours stay rows, minima are
    combined before they are shuffled, and adaptive execution splits the join of a hub that has too many of them. Nothing goes to
    the driver but whether a node is left that is no star's; each round deletes what the one before it wrote.
    """
    pair = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    first = saved(pair.distinct())  # edges need not be there any more when the result is read
    now, lonely = first.where("u <> v"), first.where("u = v")
    while not stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = saved(both.join(least.withColumn("m", F.least("u", "m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        done, now = now, saved(small.distinct())
        if hasattr(done, "_steward_path"):
            forget(done)
        forget(large)
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).union(lonely)
    return ends.groupBy("node").agg(F.min("component").alias("component"))


def stars(edges: DataFrame) -> bool:
    """Whether each node that has a lesser one, of edges (u, v) with u > v, has this one edge only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.count("*").alias("n"), F.max("up").alias("up")).where("up = 1 and n > 1").isEmpty()
