"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join
that the runtime can split where one node has very many edges.  No edge, label
or component reaches the driver; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest; edges come as a < b."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).filter("x <> y")
    return moved.unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y"))).toDF("a", "b")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node.

    ``edges`` has longs ``a`` and ``b`` without nulls; order, repeats and loops don't matter.
    """
    start = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = scratch.table(start, "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    # Ends: each round but the last lowers some node's label.
    while seen[0]:
        nxt = scratch.table(_small_star(_large_star(now).distinct()).distinct(), "stars")
        scratch.drop(now)
        now, got = nxt, mark(nxt)
        if got == seen:
            break
        seen = got
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
