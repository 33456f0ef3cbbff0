"""Connected components of an edge table by alternating large and small stars.

Every round rewires edges towards smaller ids and is written to the shared folder, so no lineage grows
and nothing but two sums comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """`edges` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id in the edges (a, b); the root is the smallest id of the component, itself included."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, seen = materialize(edges), None
    while True:
        total = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == seen or total[0] == 0:
            break
        seen = tuple(total)
        state = materialize(_small_star(_large_star(state)))
    stars = state.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("id"), "root").distinct())
