"""Every query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from touchline.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "lineitem", "orders", "customer", "supplier", "part", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.execute(catalog.ORACLES[name])
    at = {c[0]: i for i, c in enumerate(rel.description)}
    assert sorted(at) == cols
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    fix = lambda x: float(x) if isinstance(x, (float,)) or type(x).__name__ == "Decimal" else x
    want = sorted([tuple(fix(r[at[c]]) for c in cols) for r in rel.fetchall()], key=key)
    got = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=key)
    assert len(got) == len(want) and got
    assert got == want
