"""Every registered query against its oracle SQL at the smallest scale."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canonical

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, duck):
    mine = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(mine) >= 0
        return
    other = duck.execute(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    a, b = canonical(mine), canonical(other)
    assert len(a) == len(b)
    assert a.equals(b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    totals = {r["level"]: r["t"] for r in df.groupBy("level").sum("total").withColumnRenamed("sum(total)", "t").collect()}
    assert len(set(totals.values())) == 1
