"""Every registered link query against its SQL, on the small tables."""

from pathlib import Path

import duckdb
import pytest

from linkloom import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(str([r[c] for c in cols]) for r in df.collect())
    rel = duck.sql(Q.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted(str([r[i] for i in at]) for r in rel.fetchall())
