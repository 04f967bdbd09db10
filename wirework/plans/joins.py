"""Join helpers.

``left_lookup``: a left join on a nullable key.  Rows with a NULL key can never
match, yet a shuffle would send all of them to one partition (hash of NULL); when
most rows have no key (changes other than assignments have no assignee) that
partition would hold most of the data.  A second key spreads them: a hash of the
row where the key is NULL, 0 elsewhere and in the lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_lookup(df: DataFrame, key: str, lookup: DataFrame, spread_by: list[str] | None = None) -> DataFrame:
    """``df`` left-joined with ``lookup`` on ``key``; ``df`` is read once.  ``spread_by``
    are columns that tell rows apart (all by default)."""
    spread = F.when(F.col(key).isNull(), F.xxhash64(*(spread_by or df.columns))).otherwise(F.lit(0))
    return (df.withColumn("_spread", spread)
            .join(lookup.withColumn("_spread", F.lit(0).cast("bigint")), [key, "_spread"], "left").drop("_spread"))
