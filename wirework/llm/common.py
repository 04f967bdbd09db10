"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wirework-{label}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a statement when it has ended, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders to delete when the innermost ``temporary_tables`` ends, by nesting.
_temporary: ContextVar[tuple[list[str], ...]] = ContextVar("temporary", default=())


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end.  What is returned must have been
    written with ``keep``: it then stands by itself, also after a lost executor."""
    paths: list[str] = []
    token = _temporary.set((*_temporary.get(), paths))
    try:
        yield
    finally:
        _temporary.reset(token)
        for path in paths:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later
    steps read the same rows after a lost executor, only the columns they need,
    and the lineage is cut.  Its shuffle files go once it is written.  ``keep``: the table
    outlives the innermost ``temporary_tables``."""
    path = shared_path(df.sparkSession, label)
    scopes = _temporary.get()[:-1] if keep else _temporary.get()
    if scopes:
        scopes[-1].append(path)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_order(df: DataFrame) -> DataFrame:
    """Add ``part`` and ``row`` (bigint), by which the rows of a table that Spark wrote
    sorted, and that ``df`` reads, stand in that order again: part files are numbered
    in range order, but a scan packs them by length.  ``part`` is NULL in files that
    Spark didn't name."""
    name = F.col("_metadata.file_name")
    number, piece = (F.regexp_extract(name, r"^part-(\d+)-.*-c(\d+)\.", k).try_cast("bigint") for k in (1, 2))
    # more than one piece with spark.sql.files.maxRecordsPerFile only
    return df.withColumns({"part": number * 1_000_000 + piece, "row": F.col("_metadata.row_index")})


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_hash(*cols: Column, salt: str = "") -> Column:
    """A pseudo-random order every engine can compute: md5 of the columns as text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat(F.lit(salt), *parts).cast("binary"))


def running_total(df: DataFrame, group: list[str], order: str, ties: list[str], value: str | None, out: str,
                  rows_per_bucket: int = 4_000, rows: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` (of 1 when None) over the rows of the same
    ``group`` strictly before each row by (``order``, ``ties``).

    ``order`` is an md5 hex string, so its first six digits cut every group into
    buckets of about ``rows_per_bucket`` rows whatever the data: a group that
    holds a third of all rows is spread over as many tasks as its size asks for.
    Each bucket is summed by a window of its own; one row per (group, bucket)
    carries the sums of the buckets before it.  Group columns must not be NULL.
    """
    n = df.count() if rows is None else rows
    buckets = max(1, min(1 << 24, math.ceil(n / rows_per_bucket)))
    cut = F.floor(F.conv(F.substring(order, 1, 6), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 24))
    v = F.lit(1) if value is None else F.col(value)
    rows_ = df.withColumn("_rt_b", cut.cast("int"))
    keys = [*group, "_rt_b"]
    before = F.coalesce(F.sum(v.cast("bigint")).over(
        Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = part.orderBy("_rt_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows_.groupBy(*keys).agg(F.sum(v.cast("bigint")).alias("_rt_s"))
               .withColumn("_rt_o", F.coalesce(F.sum("_rt_s").over(earlier), F.lit(0))).drop("_rt_s"))
    return (rows_.withColumn("_rt_i", before).join(offsets, keys)
            .withColumn(out, (F.col("_rt_i") + F.col("_rt_o")).cast("bigint")).drop("_rt_b", "_rt_i", "_rt_o"))
