"""Connected components of a link table.

Star contraction: in turn every node's larger neighbours, and its smaller ones, are
linked to the smallest it knows.  The number of rounds grows with the logarithm of the
nodes and not with the length of a chain; each round is two grouped minima
and two joins, written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import materialize


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component; roots stand for themselves)
    of a table of links (a, b), bigint; nodes without a link are left out."""
    links = links.filter("a <> b")
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        found = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
