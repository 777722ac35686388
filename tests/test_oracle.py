"""Every query with SQL gives the rows of that SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest

from benchloom.plans import registry


def rows(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "NULL"
        if isinstance(v, float):
            return repr(round(v, 8) + 0.0)
        return str(v.tolist() if hasattr(v, "tolist") else v)

    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_without_optional_part(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as e

    real = builtins.__import__

    def fake(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("benchloom.llm"):
            raise ImportError(name, name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", fake)
    try:
        importlib.reload(e)
        assert e.queries().keys() == registry.QUERIES.keys()
    finally:
        monkeypatch.undo()
        importlib.reload(e)
