"""Dense ids for new rows without funnelling them through one partition.

``row_number() OVER (ORDER BY k)`` with no partition key moves every row to a
single task.  Instead the rows are range-partitioned by all order columns: Spark
samples them, so the chunks are about equal whatever the values are, with outliers
and with many rows of one first column too, and adaptive execution merges chunks that
turn out small.  Each chunk is sorted and its rows are counted through
(``monotonically_increasing_id``), and the result is written once in the shared folder:
readers see the same chunks, and a lost executor changes no id.  The chunks' sizes
(one row per chunk, a bounded side) give each its offset.  Ids follow the global
order: new id = ``start + rank(order)``, the numbers a sequential AUTO_INCREMENT
hands out when rows arrive in that order.  NULL keys sort first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a position that count rows inside a chunk (those of monotonically_increasing_id).
CHUNK_BITS = 33

#: Spark deletes the shuffle files of a statement when it has ended, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders to delete when the innermost ``temporary_tables`` ends, by nesting.
_temporary: ContextVar[tuple[list[str], ...]] = ContextVar("temporary", default=())


def reuse(df: DataFrame) -> DataFrame:
    """Keep a batch that is read several times (memory, spilling to disk).  The
    ids computed from it depend on its rows only, so blocks lost with an
    executor are recomputed to the same values."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Statements that run inside leave no shuffle files."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete the folders, and take them from the list."""
    while paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(paths[-1])
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        paths.pop()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``materialize`` writes inside are deleted at the end, their shuffle files as soon as they are
    written: what reads them must have run by then.  Gives the list of their folders."""
    paths: list[str] = []
    token = _temporary.set((*_temporary.get(), paths))
    try:
        yield paths
    finally:
        _temporary.reset(token)
        delete_tables(spark, paths)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the cluster's shared checkpoint folder (set by
    the platform; tests set their own) and read it back.  Used where a batch is read
    several times: it is computed once, lineage is cut, readers prune columns, and
    recomputation after a lost executor reads the same rows."""
    from ..session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if scopes := _temporary.get():
        scopes[-1].append(path)
        with shuffles_deleted(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positioned(df: DataFrame, order: list[str], chunks: int | None = None, pos_col: str = "_pos") -> DataFrame:
    """``df`` written once with ``pos_col`` (bigint), which grows in ``order`` (unique);
    its upper bits (``chunk_of``) number chunks of about equal size, its lower bits
    the rows of a chunk from 0.  ``chunks`` is the most there can be
    (``spark.sql.shuffle.partitions`` by default)."""
    cut = df.repartitionByRange(*([chunks] if chunks else []), *order).sortWithinPartitions(*order)
    return materialize(cut.withColumn(pos_col, F.monotonically_increasing_id()))


def chunk_of(pos: str) -> Column:
    return F.shiftright(pos, CHUNK_BITS).cast("int")


def row_of(pos: str) -> Column:
    return F.col(pos).bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))


def assign_ids(df: DataFrame, order: list[str], start: DataFrame | int, id_col: str = "id",
               start_col: str = "start", buckets: int | None = None) -> DataFrame:
    """Add ``id_col`` = start + 1-based rank by ``order`` (order must be unique).

    ``start`` is an int or a one-row DataFrame with column ``start_col`` (e.g.
    ``max_id(table)``).
    """
    rows = positioned(df, order, buckets).withColumn("_b", chunk_of("_pos"))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))                       # a row per chunk
    prior = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"))
    if isinstance(start, int):
        base: Column = F.lit(start)
    else:
        base = F.coalesce(start.select(F.col(start_col)).scalar(), F.lit(0))   # one-row subquery
    out = rows.join(F.broadcast(offsets), "_b")
    out = out.withColumn(id_col, (base + F.col("_off") + row_of("_pos") + 1).cast("bigint"))
    return out.drop("_b", "_pos", "_off")


def index_within(df: DataFrame, key: str, order: list[str], out_col: str) -> DataFrame:
    """Add ``out_col``: the 1-based place of each row among those of its ``key`` by
    ``order`` (unique within the key).  Rows are numbered over all keys and each
    key's first number is subtracted, so a key with very many rows needs no window
    of its own.  NULL keys count as one."""
    numbered = materialize(assign_ids(df, [key, *order], 0, "_g"))
    first = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_g").alias("_f"))
    out = numbered.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn(out_col, F.col("_g") - F.col("_f") + 1).drop("_g", "_f", "_key")


def max_id(df: DataFrame, col: str = "id") -> DataFrame:
    """One-row DataFrame ``start`` = max(col) (NULL -> 0)."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("bigint").alias("start"))


def prefix_sum(df: DataFrame, order: list[str], value: str, out_col: str,
               buckets: int | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``value`` over all rows strictly before each row
    in ``order`` (order must be unique), computed per chunk plus a per-chunk
    offset, like ``assign_ids``; no single-partition window."""
    rows = positioned(df, order, buckets).withColumn("_b", chunk_of("_pos"))
    w = Window.partitionBy("_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    totals = rows.groupBy("_b").agg(F.sum(value).alias("_t"))
    prior = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_off"))
    return (within.join(F.broadcast(offsets), "_b")
            .withColumn(out_col, (F.col("_off") + F.col("_in")).cast("bigint"))
            .drop("_b", "_in", "_off", "_pos"))
