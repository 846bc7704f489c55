"""Every registered query of the engine itself against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from glossara.plans import registry

registry.load()
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return c


def value(x):
    if x is None or isinstance(x, float) and x != x or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, bool) or getattr(getattr(x, "dtype", None), "kind", "") == "b":
        return bool(x)
    if isinstance(x, (int, float)) or getattr(getattr(x, "dtype", None), "kind", "") in "iuf" and hasattr(x, "dtype"):
        return None if x != x else round(float(x), 6) + 0.0
    return x


def rows(df):
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def same(a, b):
    return len(a) == len(b) and all(len(x) == len(y) and all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-6) for p, q in zip(x, y)) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    expected = con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert same(rows(got), rows(expected))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
