"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins; the number of rounds grows with
the logarithm of the component size, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.plans.lineage import cut


#: A node with more than this share of the edges counts as hot; so there are few of them, however large the graph.
_HOT_SHARE = 256


def _with_least(edges: DataFrame, least: DataFrame, hot_from: int) -> DataFrame:
    """Adds ``m`` of ``least(a, m, n)`` to ``edges(a, b)``.

    All nodes of a giant component end up under its root. The few nodes with over ``hot_from`` edges are looked up where
    the edges lie; only the others are shuffled to meet their minimum.
    """
    hot = F.broadcast(least.filter(F.col("n") > hot_from).select("a", F.col("m").alias("_hot")))
    marked = edges.join(hot, "a", "left")
    rest = marked.filter(F.col("_hot").isNull()).select("a", "b").join(least.select("a", "m"), "a")
    return marked.filter(F.col("_hot").isNotNull()).select("a", "b", F.col("_hot").alias("m")).unionByName(rest.select("a", "b", "m"))


def _large_star(edges: DataFrame, hot_from: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both.filter(F.col("b") > F.col("a")), least, hot_from).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, hot_from: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, hot_from).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` from ``nodes(node)`` and undirected ``edges(a, b)``.

    The component is named after its smallest node.
    """
    current = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        hot_from = max(1000, seen[0] // _HOT_SHARE)
        current = cut(_small_star(_large_star(current, hot_from), hot_from))
    return nodes.join(current.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )
