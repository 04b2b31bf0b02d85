"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b) with a > b are stars around b: each a has one edge, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node of its component.

    Each iteration is stored through a reliable checkpoint; the number of iterations grows with the logarithm
    of the number of nodes, and the edges themselves tell when they are stars. Loops and repeated edges are allowed; an
    empty table gives an empty table. The joins are by sort and merge, so that no table passes through the driver.
    """
    done = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(done):
        done = materialise(_small_star(_large_star(done)))
    roots = done.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return done.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
