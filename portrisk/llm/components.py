"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import stored


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest of u and all v paired with it.

    The minimum is an aggregate combined before the shuffle and the join back has nothing
    keyed above it, so a node with very many neighbours can be split over tasks.
    """
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return (pairs.join(least, F.col("u") == F.col("k"))
            .select("u", "v", F.least("u", "m").alias("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns u, v); root is its component's
    smallest node.  Nodes of no edge are not listed; an empty table gives an empty table.

    Each round links larger neighbours to the neighbourhood's minimum (large star), then
    smaller ones (small star), and writes the new edges.  It ends when every node hangs on
    its root directly; the number of rounds grows with the logarithm of the longest path.
    """
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"),
                                             F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        sums = e.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums["n"] == 0 or sums == seen:
            break
        seen = sums
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        small = _star(large.filter("v < u"))
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .union(small.select("u", F.col("m").alias("v")))
                   .filter("u <> v").distinct(), "edges")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(e.select(F.col("v"), F.col("v"))).distinct())
