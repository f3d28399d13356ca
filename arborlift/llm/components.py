"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlift.session import stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Join each node's neighbours to the smallest of them and itself.

    Large star moves the neighbours greater than the node, small star those that
    are not; both keep components and shorten paths.
    """
    both = edges.select(F.col("u"), F.col("v"))
    if larger:
        both = both.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if larger:
        return moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    pairs = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(moved.select("u", F.col("m").alias("v")))
    return pairs.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest id of its component.

    ``edges`` has columns u, v; loops are ignored. Each round is staged; the
    rounds end when all edges lead to roots.
    """
    now = stage(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    for _ in range(rounds):
        if _settled(now):
            break
        now = stage(_star(_star(now, True), False), "components")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none of its own."""
    if edges.isEmpty():
        return True
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    onward = edges.select(F.col("v").alias("w")).join(edges.select(F.col("u").alias("w")), "w", "left_semi")
    return several.isEmpty() and onward.isEmpty()
