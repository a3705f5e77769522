"""The driver contract: every query builds and runs on the smallest tables, and equals its SQL."""

import pathlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quarrykit.plans import catalogue

DATA = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def canon(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "" if pd.api.types.is_scalar(v) and pd.isna(v) else str(round(float(v), 6)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
