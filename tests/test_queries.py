"""Every engine query against its SQL in DuckDB, on the smallest driver tables."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from emberlog import log_queries as queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (Decimal, float)) and v == v and v == int(v):
        return int(v)
    return None if v is None or v != v else v if isinstance(v, (int, float, bool)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    df = queries.Q[name](spark, DATA)
    res = duck.execute(queries.SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in res.fetchall()), key=repr)
