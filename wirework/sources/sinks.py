"""Sinks: how the outputs of the change operators are written.

Operators return new DataFrames; nothing is updated in place.  A table is
replaced by writing the new version to its own path and switching readers to
it (a failed write leaves the old version intact), or extended by appending
(A2's report log, D17's activity entries, notifications).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .tables import TABLE_NAMES, Tables


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows (report log, activity log, notifications)."""
    df.write.mode("append").format(fmt).save(path)


def write_version(df: DataFrame, base: str, version: int, fmt: str = "parquet",
                  partition_by: list[str] | None = None) -> str:
    """Write a full new version of a table under ``base/v{version}``; re-running
    the same version overwrites it, so a retried job is idempotent."""
    path = f"{base}/v{version}"
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_tables(T: Tables, path: str, fmt: str = "parquet") -> None:
    """Write every table of the data model as ``path/<table>`` (readable again
    with ``load_tables``)."""
    for name in TABLE_NAMES:
        getattr(T, name).write.mode("overwrite").format(fmt).save(f"{path}/{name}")
