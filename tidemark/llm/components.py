"""Connected components of an edge table by alternating stars, each step a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or itself and the smaller ones) to its least neighbour."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    out = both.join(least, "a")
    out = out.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")) if large else out.select(
        F.col("b").alias("a"), F.col("least").alias("b")
    ).union(least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b), the root being the least node of its component.

    Stars grow and are tied to smaller roots in turn until nothing changes; the number of rounds grows with the
    logarithm of the nodes. No group is gathered: a hub only takes part in a minimum and a join.
    """
    tied = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    was = None
    while True:
        state = tied.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            break
        was = state
        tied = cut(_star(_star(tied, True), False))
    return tied.select(F.col("a").alias("node"), F.col("b").alias("root")).union(tied.select("b", "b")).distinct()
