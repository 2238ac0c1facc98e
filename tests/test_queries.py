"""Every registered query with SQL against DuckDB on the smallest data."""

import math
import os

import duckdb
import pytest

from fernweave.plans import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(_norm, r))) for r in df.select(*cols).collect())
    said = ", ".join(f'"{c}"' for c in cols)
    want = sorted(repr(tuple(map(_norm, r))) for r in con.sql(f"SELECT {said} FROM ({q.ORACLE_SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_others_run(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
