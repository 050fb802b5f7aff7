"""Connected components of a large edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.plans.reuse import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top"))
    ends = ends.unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    per_node = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return not per_node.where("low > 1 OR low = 1 AND top = 1").head(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), a < b; the root is the least node, itself not listed.

    Each round is two joins and two sums over the edges, written to the shared folder; rounds
    grow with the logarithm of the longest path. Null ends are left out.
    """
    now = materialize(edges.where("a < b").select("a", "b").distinct(), "edges")
    while not _are_stars(now):
        now = materialize(_small_star(_large_star(now)), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """`roots` of a graph after more edges (a, b): only the classes that these edges join are worked on."""
    top = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = edges.select("a", "b").join(top("a"), "a", "left").join(top("b"), "b", "left")
    a, b = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
    joined = components(ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(old.unionByName(joined), "roots")
