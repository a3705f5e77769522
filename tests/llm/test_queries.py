"""The queries of the subpackage run on the smallest tables; those with SQL equal it."""

import pathlib

import duckdb
import pytest

from quarrykit.llm import queries as Q
from quarrykit.llm import sql as S

DATA = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, name):
    df = Q.queries()[name](spark, str(DATA))
    n = df.count()
    assert n >= 0
    if name in S.oracle_sql():
        c = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        want = c.execute(S.oracle_sql()[name]).fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
