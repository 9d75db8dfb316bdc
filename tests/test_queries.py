"""Every query with SQL beside its SQL, on the smallest tables; the contract of the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canonical

CORE = [n for m in entry._MODULES if "llm" not in m.__name__ for n in m.QUERIES]


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    return c


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_same_as_sql(spark, con, small, name):
    got, want = entry.queries()[name](spark, small).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", [n for n in CORE if n not in entry.oracle_sql()])
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
