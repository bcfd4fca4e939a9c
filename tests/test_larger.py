"""Queries against their SQL on made tables that hold what the smallest driver tables do not."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from emberlog import log_queries as queries
from emberlog.operators import cron, read, scan
from test_queries import plain

EVENT = "event_id long, user_id long, event_type string, value double"


@pytest.fixture
def same(spark, tmp_path):
    """same(name, table=(schema, rows), …): the query over these tables gives what its SQL does."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = queries.Q[name](spark, str(tmp_path))
        res = con.execute(queries.SQL[name])
        names = [c[0] for c in res.description]
        assert sorted(df.columns) == sorted(names)
        got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        assert got == sorted((tuple(map(plain, r)) for r in res.fetchall()), key=repr)
        return got

    return check


def test_sampled_ticks_of_odd_events(same):
    """Null users, values and ids, ids below 0 and a user whose values are all null."""
    rows = [(k - 60, None if k % 17 == 0 else k % 7, "view", None if k % 7 == 3 or k % 5 == 0 else k / 4) for k in range(0, 900, 3)]
    got = same("cron_every_n", events=(EVENT, [*rows, (None, 1, "view", 1.0), (100, 50, "view", 2.5), (101, 51, "view", 3.5), (830, 52, "view", 1.0)]))
    assert {r[2] for r in got if r[0] == 3} == {None} and any(r[0] is None for r in got)


def test_sampled_ticks_are_not_moved(spark):
    """No tick is shuffled, sorted or joined; values hold over chunks of ticks."""
    known = spark.createDataFrame([("x", 5, 1), ("x", 10, 2), ("x", 11, 3), ("y", 95, 4), ("y", 101, 5)], "k string, b long, value long")
    df = cron.sampled(known, ["k"], "b", 10, 100, 3)
    above, generator, below = df._jdf.queryExecution().executedPlan().toString().partition("Generate explode")
    assert generator and "Exchange" in below and not any(x in above for x in ("Exchange", "Sort", "Join", "Window")) and "Join" not in below
    assert sorted((r["k"], r["tick"], r["value"]) for r in df.collect()) == [("x", 10, 2), *(("x", t, 3) for t in range(20, 101, 10)), ("y", 100, 4)]
    assert cron.sampled(known.where(F.lit(False)), ["k"], "b", 10, None).count() == 0


def test_addresses_beyond_any_list(same):
    """Users above 4,000, below 0 and null."""
    rows = [(k, u, "view", k / 4) for k, u in enumerate([0, 1, 2, 3998, 4000, 4001, 8_000_000, 2**62, -2, -3, None, 4000])]
    assert [r[1] for r in sorted(same("address_semijoin", events=(EVENT, rows)))] == [0, 2, 3998, 4000, 8_000_000, 2**62, -2, 4000]


def test_a_list_of_addresses_is_whole(spark):
    """One too long for a filter's literals."""
    wanted = [f"0x{k:040X}" for k in range(0, 4 * scan.MAX_LITERALS, 2)]
    df = spark.range(5 * scan.MAX_LITERALS).withColumn("address", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("id")), 40, "0")))
    assert sorted(r["id"] for r in scan.addresses(df, "address", wanted).collect()) == list(range(0, 4 * scan.MAX_LITERALS, 2))


def test_relations_beyond_a_page(same):
    """Nations of 2,500, 1,000 and no customers, one listed twice; null keys on both sides."""
    nation = [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "d"), (None, "e")]
    of = [0] * 2500 + [1] * 1000 + [3] * 1001 + [None] * 3
    customer = [(None if k % 400 == 7 else len(of) - k, f"n{k}", n, "BUILDING") for k, n in enumerate(of)]
    got = same("relation_nested", nation=("n_nationkey int, n_name string", nation), customer=("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", customer))
    assert {r[0]: r[1] for r in got} == {0: 2493, 1: 998, 2: 0, 3: 2 * 998, None: 0}


def test_related_pages_hold_all_children(spark):
    parent, child = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(i, k) for i, n in ((1, 9), (3, 4), (4, 1)) for k in range(n)], "id long, c long")
    got = sorted((r["id"], r["page"], [x["c"] for x in r["kids"]]) for r in read.related_pages(parent, child, "id", "id", ["c"], "kids", 4).collect())
    assert got == [(1, 0, [0, 1, 2, 3]), (1, 1, [4, 5, 6, 7]), (1, 2, [8]), (2, 0, []), (3, 0, [0, 1, 2, 3])]


def test_wide_texts_of_no_cents(same):
    """Users whose latest, highest and summed cents are 0, alone and after others."""
    values = {0: [0.0], 1: [2.5, 0.0], 2: [0.0, 0.0, 0.0], 3: [0.0, 7.25], 4: [3.0, 0.0, 0.01], 5: [1e6, 0.0]}
    rows = [(10 * k + u, u, "view", v) for u, own in values.items() for k, v in enumerate(own)]
    got = {r[0]: r[1:] for r in same("u256_sum", events=(EVENT, rows))}
    assert got[1] == (f"250{12:038d}", "250" + "0" * 38, f"0{11:038d}") and got[2] == (f"0{36:038d}", "0" * 39, f"0{22:038d}")
