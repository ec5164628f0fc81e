"""Connected components by alternating large-star and small-star.

Each round is two group minima and two joins on the nodes of the edges; a node with very many edges is
pre-aggregated for its minimum and its join partition can be split by adaptive execution.  Nothing is
collected but one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest node around it."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node that has an edge to another; the component is its smallest node.

    ``edges`` has two columns of longs in any order.  Loops, repeats and null ends are ignored.
    """
    a, b = edges.columns
    now = stage(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("a <> b")
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        then = stage(_small_star(_large_star(now).distinct()).distinct(), "edges")
        release(now)
        now = then
        total = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (total.n, total.s) == mark:
            break
        mark = (total.n, total.s)
    children = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return children.unionByName(children.select(F.col("component").alias("node"), "component").distinct())
