"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from spanweave.queries import ORACLE_SQL, QUERIES
from spanweave.session import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in ORACLE_SQL:
        made = duck.execute(ORACLE_SQL[name])
        want = rows([c[0] for c in made.description], made.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]
