"""Connected components by alternating large-star and small-star steps.

Nodes are keys of any type that is ordered.  Every step is a grouped minimum and a join on shuffled edges; what it
makes is written to the shared folder, so lineage stays short and nothing but two numbers
reaches the driver.  It ends when a round changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: links each larger neighbour of a node to the least of its neighbours and itself; small: the smaller ones and the node."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # a > b in edges: the pairs (a, b) are each node's smaller neighbours.
    own = edges.unionByName(flipped) if large else edges
    least = own.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = own.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """links (a, b) -> (key, root): the least key that each linked key reaches.  Unlinked keys are not in it."""
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    for _ in range(most):
        now = materialise(_star(_star(edges, True), False), "edges")
        # Both are sets: they are equal if they are as large and none is in one only.
        settled = now.count() == edges.count() and now.join(edges, ["a", "b"], "left_anti").isEmpty()
        discard(edges)
        edges = now
        if settled:
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("key"), F.col("b").alias("root")))
    raise RuntimeError(f"components not settled after {most} rounds")
