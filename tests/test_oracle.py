"""Every registered query against its SQL on the smallest tables; the others must return rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.util import TABLES, compare

SF = "/root/testdata/sf0.001"
SLOW = {"m14_window_robustness"}  # covered at larger scale by tools/check.py


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    msg = compare(df, rows, con.execute(sql))
    assert msg.startswith("ok"), msg
