"""Folds, retraction and manifests: against plain Python, and by what must not change a result."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberlog.functions import u256
from emberlog.operators import blocktime, cron, fold, iterate, messages, read, reorg, scan
from emberlog.plans import manifest

SCHEMA = "evt_seq long, network string, k long, x long, kind string"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    rows = [(s, rng.choice(["a", "b"]), rng.randint(1, 6), rng.randint(0, 50), rng.choice(["up", "up", "up", "upd", "del"])) for s in range(300)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def table(ops, columns, **more):
    return manifest.table({"name": "t", "columns": [{"name": "k", "type": "int64"}, *columns], "events": [{"event": "log", "operations": ops}], **more})


def sets(**more):
    return [{"column": c, "action": a, "value": v} for c, (a, v) in more.items()]


COLUMNS = [{"name": "total", "type": "int128", "default": 0}, {"name": "last", "type": "int64", "nullable": True}, {"name": "high", "type": "int64", "nullable": True}]
UP = {"type": "upsert", "where": {"k": "$k"}, "if": "kind == 'up'", "set": sets(total=("add", "$x"), last=("set", "$x"), high=("max", "$x"))}
UPDATE = {"type": "update", "where": {"k": "$k"}, "if": "kind == 'upd'", "set": sets(total=("subtract", "$x"), last=("set", "$x"))}
DELETE = {"type": "delete", "where": {"k": "$k"}, "if": "kind == 'del'"}


def plain(rows, kinds):
    state = {}
    for seq, network, k, x, kind in sorted(rows):
        key = (network, k)
        if kind == "up" and "up" in kinds:
            s = state.setdefault(key, [0, None, None, seq])
            state[key] = [s[0] + x, x, x if s[2] is None else max(s[2], x), seq]
        elif kind == "upd" and "upd" in kinds and key in state:
            s = state[key]
            state[key] = [s[0] - x, x, s[2], seq]
        elif kind == "del" and "del" in kinds:
            state.pop(key, None)
    return {key: tuple(v) for key, v in state.items()}


def result(df):
    return {(r["network"], r["k"]): (int(r["total"]), r["last"], r["high"], r["evt_seq"]) for r in df.collect()}


@pytest.mark.parametrize("kinds", [("up",), ("up", "upd"), ("up", "del"), ("up", "upd", "del")])
def test_fold_is_the_sequential_one(log, kinds):
    t = table([{"up": UP, "upd": UPDATE, "del": DELETE}[k] for k in kinds], COLUMNS)
    assert result(fold.fold({"log": log}, t)) == plain([tuple(r) for r in log.collect()], kinds)


@pytest.mark.parametrize("kinds", [("up",), ("up", "upd"), ("up", "del"), ("up", "upd", "del")])
@pytest.mark.parametrize("cut", [0, 77, 200])
def test_batches_do_not_matter(log, kinds, cut):
    t = table([{"up": UP, "upd": UPDATE, "del": DELETE}[k] for k in kinds], COLUMNS)
    first = fold.fold({"log": log.where(F.col("evt_seq") < cut)}, t)
    assert result(fold.fold({"log": log.where(F.col("evt_seq") >= cut)}, t, first)) == plain([tuple(r) for r in log.collect()], kinds)


@pytest.mark.parametrize("kinds", [("up",), ("up", "upd", "del")])
def test_retracted_is_never_seen(log, kinds):
    t = table([{"up": UP, "upd": UPDATE, "del": DELETE}[k] for k in kinds], COLUMNS)
    out = reorg.retract(fold.fold({"log": log}, t), {"log": log}, t, "evt_seq", 100, 180)
    assert result(out) == plain([tuple(r) for r in log.collect() if not 100 <= r["evt_seq"] <= 180], kinds)


def test_global_and_cross_network(log):
    ops = [{"type": "upsert", "where": {}, "set": sets(total=("increment", "1"))}]
    t = manifest.table({"name": "t", "global": True, "columns": [{"name": "total", "type": "int64"}], "events": [{"event": "log", "operations": ops}]})
    assert {(r["network"], int(r["total"])) for r in fold.fold({"log": log}, t).collect()} == {(r["network"], r["count"]) for r in log.groupBy("network").count().collect()}
    both = manifest.table({"name": "t", "global": True, "cross_chain": True, "columns": [{"name": "total", "type": "int64"}], "events": [{"event": "log", "operations": ops}]})
    assert [int(r["total"]) for r in fold.fold({"log": log}, both).collect()] == [300]
    assert [int(r["total"]) for r in fold.fold({"log": log}, both, fold.fold({"log": log}, both)).collect()] == [600]


def test_running_extreme_by_condition(log):
    t = table([{"type": "upsert", "where": {"k": "$k"}, "if": "$x > @high", "set": sets(high=("set", "$x"), last=("set", "$kind"))}], [{"name": "high", "type": "int64"}, {"name": "last", "type": "string"}])
    want = {}
    for r in log.orderBy("evt_seq").collect():
        key = (r["network"], r["k"])
        if key not in want or r["x"] > want[key][0]:
            want[key] = (r["x"], r["kind"])
    assert {(r["network"], r["k"]): (r["high"], r["last"]) for r in fold.fold({"log": log}, t).collect()} == want


@pytest.mark.parametrize("cut", [0, 100])
def test_conditions_on_the_stored_row_in_order(log, cut):
    """Conditions that no aggregate expresses, in one batch and in two, against plain Python."""
    columns = [{"name": "total", "type": "int128", "default": 0}, {"name": "last", "type": "int64", "nullable": True}, {"name": "wide", "type": "uint256", "default": 0}]
    ops = [
        {"type": "upsert", "where": {"k": "$k"}, "if": "$x + 3 > @last && @total < 400", "set": sets(total=("add", "$x"), last=("set", "$x"), wide=("add", f"$x * {2**200}"))},
        {"type": "update", "where": {"k": "$k"}, "if": "@total >= 300 && x % 2 == 0".replace("x % 2 == 0", "x > 10"), "set": sets(total=("subtract", "$x"))},
        {"type": "delete", "where": {"k": "$k"}, "if": "kind == 'del' && @total > 350"},
    ]
    t = table(ops, columns)
    rows = {}
    for seq, network, k, x, kind in sorted(tuple(r) for r in log.collect()):
        key = (network, k)
        r = rows.get(key)
        if r is None or x + 3 > r[1] and r[0] < 400:
            old = r or (0, None, 0, 0)
            r = rows[key] = (old[0] + x, x, old[2] + x * 2**200, seq)
        if r[0] >= 300 and x > 10:
            r = rows[key] = (r[0] - x, *r[1:3], seq)
        if kind == "del" and r[0] > 350:
            del rows[key]
    first = fold.fold({"log": log.where(F.col("evt_seq") < cut)}, t) if cut else None
    out = fold.fold({"log": log.where(F.col("evt_seq") >= cut)}, t, first).withColumn("wide", u256.to_decimal(F.col("wide")))
    assert {(r["network"], r["k"]): (int(r["total"]), r["last"], int(r["wide"]), r["evt_seq"]) for r in out.collect()} == rows


def test_insert_keeps_every_row(log):
    t = table([{"type": "insert", "where": {}, "if": "x > 25", "set": sets(k=("set", "$k"), last=("set", "$x"))}], [{"name": "last", "type": "int64"}, {"name": "side", "type": "string", "default": "in"}])
    out = fold.fold({"log": log}, t)
    assert sorted((r["evt_seq"], r["k"], r["last"], r["side"]) for r in out.collect()) == sorted((r["evt_seq"], r["k"], r["x"], "in") for r in log.where("x > 25").collect())


def test_iterate_needs_equal_lengths(spark):
    df = spark.createDataFrame([(1, [1, 2], [3, 4]), (2, [1], [2, 3]), (3, [], []), (4, None, [1]), (5, [7], [None])], "i int, a array<int>, b array<int>")
    assert sorted(map(tuple, iterate.iterate(df, (("a", "x"), ("b", "y"))).select("i", "x", "y").collect())) == [(1, 1, 3), (1, 2, 4), (5, 7, None)]


def test_manifest_inference_and_checks():
    assert manifest.infer_type("$a", {"a": "address"}) == "address" and manifest.infer_type("$a * 2", {"a": "uint8"}) == "uint256"
    assert manifest.infer_type("$if(a, b, c)", {}) == "string" and manifest.infer_type("5", {}) == "uint256" and manifest.infer_type("0x" + "a" * 40, {}) == "address"
    assert manifest.infer_type("true", {}) == "bool" and manifest.infer_type("$evt_block_number", {}) == "uint64" and manifest.interval_seconds("5m") == 300
    for bad in (
        {"type": "upsert", "where": {}, "set": []}, {"type": "nope", "where": {"k": "$k"}}, {"type": "upsert", "where": {"k": "$k"}, "set": sets(total=("nope", "1"))},
        {"type": "upsert", "where": {"k": "$k"}, "set": sets(total=("set", "$null"))}, {"type": "insert", "where": {}, "set": sets(total=("set", "1"))}, {"type": "upsert", "where": {"k": "$k"}, "if": "((", "set": []},
    ):
        with pytest.raises((manifest.ManifestError, ValueError)):
            table([bad], [{"name": "total", "type": "int64"}])
    with pytest.raises(manifest.ManifestError):
        manifest.interval_seconds("0s")


def test_yaml(monkeypatch):
    monkeypatch.setenv("NET", "main")
    text = """
name: demo
networks: [{name: "${NET}"}]
contracts:
  - name: token
    details: [{network: main, start_block: "${START:-5}"}]
    tables:
      - name: balances
        columns: [{name: holder}, {name: balance, default: 0}]
        events:
          - event: Transfer
            operations:
              - {type: upsert, where: {holder: $to}, if: "to != 0x0", set: [{column: balance, action: add, value: $value}]}
              - {type: upsert, where: {holder: $from}, set: [{column: balance, action: subtract, value: $value}]}
"""
    spec = manifest.load(text.replace("{name: holder}", "{name: holder, type: address}").replace("{name: balance, default: 0}", "{name: balance, type: uint128, default: 0}"))
    assert spec["tables"][0].keys == ["network", "holder"]
    with pytest.raises(manifest.ManifestError):
        manifest.load(text.replace("network: main", "network: other"))
    monkeypatch.delenv("NET")
    with pytest.raises(manifest.ManifestError):
        manifest.load(text)


def test_fork_points_and_gaps(spark):
    own = spark.createDataFrame([("a", n, f"h{n}") for n in range(10, 20)] + [("b", n, f"g{n}") for n in range(5)], "network string, block_number long, block_hash string")
    other = own.withColumn("block_hash", F.when((F.col("network") == "a") & (F.col("block_number") > 15), "x").otherwise(F.col("block_hash")))
    assert [tuple(r) for r in reorg.fork_points(own, other, ["network"]).collect()] == [("a", 16)]
    none = own.withColumn("block_hash", F.lit("y"))
    assert sorted(map(tuple, reorg.fork_points(own, none, ["network"]).collect())) == [("a", 10), ("b", 0)]
    holes = spark.createDataFrame([("a", n) for n in (1, 2, 5, 99_999, 100_000, 350_000)], "network string, block_number long")
    assert sorted(map(tuple, reorg.gaps(holes, ["network"]).collect())) == [("a", 3, 4), ("a", 6, 99_998), ("a", 100_001, 349_999)]
    assert [tuple(r) for r in reorg.gaps(own.where("block_number not in (12, 13)"), ["network"]).collect()] == [("a", 12, 13)]
    assert reorg.prune_window(own, ["network"], 3).count() == 6
    assert reorg.rewound_checkpoint(18, 16) == 15


def test_times(spark):
    runs = spark.createDataFrame([("a", 1, 3, 12), ("a", 4, 2, 13)], "n string, first long, length long, delta long")
    first = spark.createDataFrame([("a", 100)], "n string, start_time long")
    assert [(r["block"], r["time"]) for r in blocktime.expand_runs(runs, first, ["n"]).orderBy("block").collect()] == [(1, 112), (2, 124), (3, 136), (4, 149), (5, 162)]
    df = spark.range(1).select(blocktime.seconds(F.lit(1_700_000_000_123)).alias("a"), blocktime.seconds(F.lit(1_700_000_000)).alias("b"), blocktime.fixed(F.lit(110), 100, 1000, 12).alias("c"))
    assert tuple(df.first()) == (1_700_000_000, 1_700_000_000, 1120)
    rows = spark.createDataFrame([("a", b, t) for b, t in [(1, None), (2, 10), (3, None), (5, 40), (250, None), (400, 830)]], "n string, b long, t long")
    assert {r["b"]: r["t"] for r in blocktime.interpolate(rows, "b", "t", ["n"], 10).collect()} == {1: None, 2: 10, 3: 20, 5: 40, 250: 40 + 245 * 790 // 395, 400: 830}


def test_cron(spark):
    ranges = spark.createDataFrame([("x", 0, 25, 10), ("y", 9, 5, None)], "k string, start long, end long, done long")
    assert [r["tick"] for r in cron.ticks(ranges, 10).orderBy("tick").collect()] == [0, 10, 20]
    assert [r["tick"] for r in cron.ticks(ranges, 10, last_done="done").collect()] == [20]
    known = spark.createDataFrame([("x", 5, 1), ("x", 10, 2), ("x", 11, 3)], "k string, b long, value long")
    ticks = cron.ticks(ranges, 10).select("k", "tick")
    assert {r["tick"]: r["value"] for r in cron.as_of(ticks, known, ["k"], "b", 7).collect()} == {0: None, 10: 2, 20: 3}


def test_scan_helpers(spark):
    assert scan.topic_of("true").endswith("1") and scan.topic_of("0x" + "ab" * 20) == "0x" + "0" * 24 + "ab" * 20 and scan.topic_of("7") == f"0x{7:064x}"
    assert scan.topic_of("Transfer(address,address,uint256)") == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    df = spark.createDataFrame([(1, "0xA"), (2, "0xb"), (3, None)], "block long, address string")
    assert [r["block"] for r in scan.addresses(df, "address", ["0xa"]).collect()] == [1]
    assert scan.addresses(df, "address", []).count() == 0 and scan.addresses(df, "address", None).count() == 3
    assert [r["block"] for r in scan.addresses(df, "address", ["0xB"] + [f"0x{k}c" for k in range(2000)]).collect()] == [2]
    assert scan.block_range(df, "block", 2, None, head=3, distance=1).count() == 1
    assert scan.resume_start(None, 5, 10) == 5 and scan.resume_start(7, 5, 10) == 8 and scan.resume_start(7, None, 10) == 10
    with pytest.raises(ValueError):
        scan.resume_start(None, 11, 10)
    logs = spark.createDataFrame([([scan.topic_of("a()"), scan.topic_of("1")],), ([scan.topic_of("a()")],), (None,)], "topics array<string>")
    assert scan.topics(logs, [["a()"], ["1", "2"]]).count() == 1 and scan.topics(logs, [["a()"], None]).count() == 2


def test_bloom():
    from emberlog.functions.keccak import keccak256

    bits = 0
    h = keccak256(b"item")
    for k in (0, 2, 4):
        bits |= 1 << (int.from_bytes(h[k : k + 2], "big") & 2047)
    bloom = bits.to_bytes(256, "big")
    assert scan.may_contain(bloom, b"item") and not scan.may_contain(bloom, b"other")


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(20)], "id long, g int")
    q = read.Query(order_by=(("g", False),), first=6)
    seen, after = [], None
    while True:
        p = read.page(df, read.Query(order_by=q.order_by, first=6, after=after), ["id"])
        seen += [r["id"] for r in p["rows"]]
        if not p["has_next"]:
            break
        after = p["end"]
    assert seen == sorted(range(20), key=lambda k: (-(k % 3), k))
    assert [r["id"] for r in read.run(df, read.Query(last=3), ["id"]).collect()] == [17, 18, 19]
    for bad in (read.Query(first=1001), read.Query(filter={"id": {"like": 1}})):
        with pytest.raises(read.QueryError):
            read.run(df, bad, ["id"])
    with pytest.raises(read.QueryError):
        read.run(df, read.Query(filter={"g": {"equalTo": 1}}), ["id"], indexed={"id"})


def test_null_sort_values_stay_on_pages(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 3), (4, None)], "id long, x long")
    for up in (True, False):
        seen, after = [], None
        while True:
            p = read.page(df, read.Query(order_by=(("x", up),), first=1, after=after), ["id"])
            assert p["has_previous"] == bool(seen)
            seen += [r["id"] for r in p["rows"]]
            if not p["has_next"]:
                break
            after = p["end"]
        assert seen == ([2, 4, 3, 1] if up else [1, 3, 2, 4])


def test_stale_updates_leave_newer_rows(spark):
    t = table([UP, UPDATE], COLUMNS)
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    state = fold.fold({"log": rows((50, "a", 1, 100, "up"))}, t)
    assert result(fold.fold({"log": rows((10, "a", 1, 7, "upd"))}, t, state)) == {("a", 1): (100, 100, 100, 50)}
    assert result(fold.fold({"log": rows((60, "a", 1, 7, "upd"))}, t, state)) == {("a", 1): (93, 7, 100, 60)}


def test_filters_reach_the_scan_and_folds_hash(spark, log, tmp_path):
    from emberlog.plans import expr

    log.write.parquet(str(tmp_path / "log"))
    df = spark.read.parquet(str(tmp_path / "log"))
    for text in ("x > 5 && k <= 3", "x > 5 || k == 2"):
        plan = df.where(expr.test(text, expr.resolver(df.schema)))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: []" not in plan and "GreaterThan(x,5)" in plan
    numeric = {"type": "upsert", "where": {"k": "$k"}, "set": sets(total=("add", "$x"), last=("set", "$x"), high=("max", "$x"))}
    for ops in ([numeric], [UP, DELETE]):
        plan = fold.fold({"log": df}, table(ops, COLUMNS))._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_chunks_stay_below_the_limit(spark):
    rows = [("a", k, n) for k, n in enumerate([30, 30, 30, 120, 10, 90, 1, 100, 100])] + [("b", k, 60) for k in range(3)]
    df = spark.createDataFrame(rows, "key string, at long, size long")
    got = messages.chunks(df, ["key"], ["at"], "size", 100).orderBy("key", "at").collect()
    assert [r["chunk"] for r in got] == [0, 0, 0, 1, 2, 2, 3, 4, 5, 0, 1, 2]


def test_related_pages_are_bounded(spark):
    parent, child = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, k) for k in range(9)], "id long, c long")
    got = {r["id"]: [x["c"] for x in r["kids"]] for r in read.related(parent, child, "id", "id", ["c"], "kids", 4).collect()}
    assert got == {1: [0, 1, 2, 3], 2: []}


def test_messages(spark):
    df = spark.createDataFrame([(1050000, [1, 2], ("a", 3))], "v long, a array<int>, s struct<x: string, y: int>")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(messages.format_value(F.col("v"), 6)) == "1.05" and one(messages.format_value(F.col("v"), 6, padded=False)) == "1.5" and one(messages.format_value(F.lit(5000000), 6)) == "5"
    assert one(messages.raw_text(F.col("a"))) == "[1, 2]" and one(messages.value_json(F.col("s"), ["x", "y"])) == '{"0":"a","1":3}'
    assert one(messages.chat("v={{ v }} {{s.x}} {{gone}}", df)) == "v=1050000 a {{gone}}"
    assert messages.narrow_enough(5, 10) and not messages.narrow_enough(5, 100) and messages.network_distance([("a", 1), ("a", 5)]) == {"a": 5}
    assert messages.safe_distance(137) == 200 and messages.safe_distance(999) == 64
