"""Connected components by alternating star contractions.

``large_star`` links the larger neighbours of every node to its smallest one,
``small_star`` the smaller ones; the edges end as one star per component, after a
number of rounds that grows with the logarithm of the longest path.  Every round is
two aggregates and two joins on the node; a node with very many links is a skewed
join key, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none itself."""
    several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return several.unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b, any order) to ``node``, ``root`` (the smallest node of the
    component) of every node with an edge.  Nodes are longs."""
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.select(most.alias("a"), least.alias("b")).filter("a <> b").distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).filter("x <> y")
                 .unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y"))))
        now = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
