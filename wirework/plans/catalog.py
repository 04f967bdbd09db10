"""Registry of the named queries: one Spark plan and, where SQL can say the same
thing, one DuckDB oracle statement per operator of the inventory.

Every query derives the data model from the driver's tables of ``sf_dir`` and
runs its operator over the whole of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import with_tables
from ..sources.tables import Tables, derive_tables

# --- fixed values: the "today" of the test fixtures ---------------------------
TASK_AS_OF = "2001-08-02"   # task, report and rating operators
LOG_AS_OF = "2024-01-31"    # activity-log, issue and account operators
# ---------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(T) -> DataFrame`` under ``name``; ``oracle`` is DuckDB SQL
    over the derived tables listed in ``tables``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(derive_tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = with_tables(oracle, list(tables))
        return fn

    return deco


def load_all() -> None:
    """Import the modules whose registrations fill the catalog."""
    from . import queries  # noqa: F401
