"""Every query of the core against its SQL on DuckDB, on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

CORE = [(k, m) for m in entry._MODULES for k in __import__("importlib").import_module(m).QUERIES]


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and "bool" not in type(v).__name__ and "datetime" not in type(v).__name__:
            return f"{float(v):.5f}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", [k for k, _ in CORE])
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.schema is not None and got.limit(5).count() >= 0
        return
    a, b = got.toPandas(), duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry_and_missing_llm(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
