"""Queries of the subpackage beside their SQL, and over the smallest tables where there is none."""

import os

import duckdb
import pytest

from compare import canonical
from slotline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    assert canonical(QUERIES[name](spark, small).toPandas()) == canonical(con.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys() - {"p10_marks"}))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
