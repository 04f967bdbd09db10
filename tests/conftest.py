import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wirework.session import build_session, ensure_checkpoint_dir

    s = build_session(master="local[4]", shuffle_partitions=4, driver_memory="8g")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="wirework-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "part", "events", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.fixture(scope="session")
def T(spark):
    from wirework.sources.tables import derive_tables

    return derive_tables(spark, SMALL)
