"""Sources: the ``Tables`` bundle and the ways to fill it (A1, A3).

Every table is a lazy DataFrame.  Nothing here triggers a Spark job: filters and
projections written by the operators later reach the Parquet scan through
Catalyst (PushedFilters / ReadSchema).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import DERIVATIONS, SOURCES, derived_columns
from .schemas import SCHEMAS, TASK_STATUSES

TABLE_NAMES = (
    "users", "electrician_details", "customers", "tasks", "task_materials",
    "task_completions", "task_ratings", "activity_logs", "notifications", "issues",
    "reports", "system_settings",
)


BATCH_NAMES = (
    "rating_events", "task_changes", "edit_materials", "completion_events", "customer_intake", "customer_patches",
    "material_payload", "issue_changes", "issue_requests", "user_patches", "user_requests",
    "toggle_requests", "notification_reads", "report_requests", "password_resets", "logins", "purge_requests",
)


class Tables:
    """The twelve tables of the data model plus optional change batches.

    Tables are DataFrames given directly or built on first access by a loader
    (so a query only plans the derivations it reads).  A change batch that was
    not given reads as ``None``.
    """

    def __init__(self, loaders: dict[str, Callable[[], DataFrame]] | None = None, **dfs: DataFrame):
        self._loaders = dict(loaders or {})
        self._dfs = dict(dfs)

    def __getattr__(self, name: str) -> DataFrame | None:
        if name.startswith("_"):
            raise AttributeError(name)
        dfs = self.__dict__["_dfs"]
        if name in dfs:
            return dfs[name]
        loaders = self.__dict__["_loaders"]
        if name in loaders:
            dfs[name] = loaders[name]()
            return dfs[name]
        if name in TABLE_NAMES or name in BATCH_NAMES:
            return None
        raise AttributeError(name)

    def with_(self, **changes: DataFrame) -> "Tables":
        return Tables(self._loaders, **{**self._dfs, **changes})

    def names(self) -> list[str]:
        return [n for n in TABLE_NAMES + BATCH_NAMES if n in self._dfs or n in self._loaders]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the declared schema of ``name``: cast present columns,
    add absent ones as typed NULLs, drop anything else."""
    have = set(df.columns)
    cols: list[Column] = []
    for f in SCHEMAS[name].fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
    """A1: read the tables of the data model stored one directory per table.

    The schema is given, never inferred, so the scan plans without touching data.
    Paths are resolved by Spark's file systems, so any URI that Spark reads will
    do.  ``reports`` / ``system_settings`` and the change batches may be missing;
    any other table that is missing is an error.
    """
    dfs = {}
    for name in TABLE_NAMES + ("rating_events", "task_changes"):
        loc = next((p for p in (f"{path}/{name}.{fmt}", f"{path}/{name}") if path_exists(spark, p)), None)
        if loc:
            dfs[name] = conform(spark.read.schema(SCHEMAS[name]).format(fmt).load(loc), name)
        elif name in ("reports", "system_settings"):
            dfs[name] = empty(spark, name)
        elif name in TABLE_NAMES:
            raise FileNotFoundError(f"no table {name} at {path}")
    return Tables(**dfs)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in the file system that Spark finds for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load_jdbc(spark: SparkSession, url: str, properties: dict[str, str],
              partitioning: dict[str, tuple[str, int, int, int]] | None = None) -> Tables:
    """A1 over JDBC: same signature, reads the live database in parallel ranges.

    ``partitioning`` maps a table to (column, lower, upper, numPartitions) so big
    tables (tasks, activity_logs) are read by many tasks, not one connection.
    """
    partitioning = partitioning or {}
    dfs = {}
    for name in TABLE_NAMES:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for k, v in properties.items():
            reader = reader.option(k, v)
        if name in partitioning:
            col, lo, hi, n = partitioning[name]
            reader = (reader.option("partitionColumn", col).option("lowerBound", lo)
                      .option("upperBound", hi).option("numPartitions", n))
        dfs[name] = conform(reader.load(), name)
    return Tables(**dfs)


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Derive the data model from the driver's TPC-H-style parquet (FIXTURES)."""
    raw: dict[str, DataFrame] = {}

    def source(name: str) -> DataFrame:
        if name not in raw:
            raw[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return raw[name]

    def loader(name: str) -> Callable[[], DataFrame]:
        def load() -> DataFrame:
            binds = {s: source(s) for s in SOURCES[name]}
            # wall-clock literals: NTZ keeps day arithmetic free of the session zone
            text = DERIVATIONS[name].replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
            df = spark.sql(text, **binds)
            assert tuple(df.columns) == derived_columns(name), (name, df.columns)
            return conform(df, name)
        return load

    loaders = {name: loader(name) for name in DERIVATIONS}
    loaders["reports"] = lambda: empty(spark, "reports")
    loaders["system_settings"] = lambda: empty(spark, "system_settings")
    return Tables(loaders)


def seed_tables(spark: SparkSession, as_of: _dt.date, users: int = 12, tasks: int = 30) -> Tables:
    """A3: small generated tables (a unit-test fixture): user 1 is the admin, every
    fourth user a manager, the rest technicians; tasks take all statuses in turn,
    with and without assignee, scheduled up to two days after ``as_of``.
    """
    noon = _dt.datetime.combine(as_of, _dt.time(12))
    role = ["Admin" if i == 1 else "Manager" if i % 4 == 2 else "Electrician" for i in range(1, users + 1)]
    people = [{"id": i, "username": f"user-{i}", "email": f"user-{i}@fixture.invalid", "full_name": f"Person {i}",
               "phone": f"07{i % 10}{i:07d}", "role": r, "status": "Inactive" if i % 11 == 0 else "Active",
               "created_at": noon - _dt.timedelta(days=i)} for i, r in enumerate(role, 1)]
    techs = [p["id"] for p in people if p["role"] == "Electrician"]
    jobs = [{"id": i, "task_code": f"T{i:06d}", "title": f"Job {i}", "priority": ("High", "Medium", "Low")[i % 3],
             "status": TASK_STATUSES[i % len(TASK_STATUSES)], "created_by": 1 + i % 2,
             "assigned_to": techs[i % len(techs)] if i % len(TASK_STATUSES) else None,
             "scheduled_date": as_of + _dt.timedelta(days=i % 3), "created_at": noon, "updated_at": noon}
            for i in range(tasks)]

    def frame(name: str, rows: list[dict]) -> DataFrame:
        return spark.createDataFrame([tuple(r.get(c) for c in SCHEMAS[name].names) for r in rows], SCHEMAS[name])

    made = {"users": frame("users", people), "tasks": frame("tasks", jobs),
            "electrician_details": frame("electrician_details", [{"electrician_id": u, "employee_code": f"K{u}"} for u in techs])}
    return Tables(**{name: made[name] if name in made else empty(spark, name) for name in TABLE_NAMES})
