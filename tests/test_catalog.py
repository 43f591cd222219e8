"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from tarnwork import catalog


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cur = duck.execute(catalog.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    assert sorted(df.columns) == cols
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted([norm(r[k]) for k in at] for r in cur.fetchall())
    assert sorted([norm(r[c]) for c in cols] for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
