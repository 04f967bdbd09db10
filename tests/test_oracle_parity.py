"""Every registered query against its DuckDB twin on the sf0.001 tables
(row count, column names and order-insensitive values)."""
import pytest

import __spark_entry__ as entry
from oracle_check import rows_of

from conftest import SMALL

QUERIES = entry.queries()
#: the training-data operators have their tests in a folder of their own
ORACLE = {k: v for k, v in entry.oracle_sql().items() if not (k == "pipeline" or k[:2] == "op" and k[2].isdigit())}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SMALL)
    scols, srows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = duck.sql(ORACLE[name])
    ocols, orows = rows_of(rel.columns, rel.fetchall())
    assert scols == ocols
    assert len(srows) == len(orows)
    assert srows == orows


def test_every_query_has_oracle_or_a_test_of_its_own():
    own = {x for x in QUERIES if x.startswith("op") and x[2].isdigit()} | {"pipeline"}
    assert set(QUERIES) - set(ORACLE) - own == {"system_usage_report", "daily_stats_report"}


@pytest.mark.parametrize("name", ["system_usage_report", "daily_stats_report"])
def test_reports_without_statement(spark, name):
    assert QUERIES[name](spark, SMALL).count() == 1


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "full_name", "employee_code", "total_tasks", "completed_tasks",
                          "avg_completion_time", "avg_rating", "performance_rating"]
    assert df.count() > 0
