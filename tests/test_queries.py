"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
from pathlib import Path

import pytest

from dendrospark import queries

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    result = db.execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in result.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_names(name):
    assert name in queries.QUERIES
