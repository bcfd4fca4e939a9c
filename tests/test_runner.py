"""A whole program from YAML: history, restarts, metadata, calls, messages, reorganisations; sinks over sockets."""

from __future__ import annotations

import http.server
import json
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from emberlog.functions import u256
from emberlog.operators import fold
from emberlog.plans import manifest
from emberlog.sources import abi, logs, sinks
from emberlog.streaming import live
from emberlog.streaming.runner import Runner
from emberlog.streaming.state import Store

PROGRAM = """
name: demo
networks: [{name: main}, {name: side}]
contracts:
  - name: Token
    details:
      - {network: main, address: "0xT0", start_block: 10}
      - {network: side, address: ["0xT1", "0xT2"]}
    abi:
      - {type: event, name: Transfer, inputs: [{name: from, type: address, indexed: true}, {name: to, type: address, indexed: true}, {name: value, type: uint256}]}
    include_events: [Transfer]
    streams:
      - sink: box
        events: [{event_name: Transfer, filter_expression: "value >= 340282366920938463463374607431768211456"}]
    tables:
      - name: balances
        timestamp: true
        columns: [{name: holder}, {name: balance, default: 0}, {name: n, type: int64, default: 0}]
        events:
          - event: Transfer
            operations:
              - {type: upsert, where: {holder: $to}, set: [{column: balance, action: add, value: $value}, {column: n, action: increment}]}
              - {type: upsert, where: {holder: $from}, set: [{column: balance, action: subtract, value: $value}, {column: n, action: increment}]}
      - name: history
        columns: [{name: holder, type: address}, {name: worth, type: uint256}]
        events:
          - event: Transfer
            operations:
              - {type: insert, set: [{column: holder, value: $to}, {column: worth, value: '$value * $call_static($evt_contract_address, "price() returns (uint8 x, uint256 price)").price'}]}
"""
BIG = 1 << 130


def raw_logs(spark):
    topic = abi.Event("Transfer", (abi.Param("from", "address", True), abi.Param("to", "address", True), abi.Param("value", "uint256"))).topic
    who = lambda k: "0x" + "0" * 24 + f"{k:040x}"
    rows = []
    for b in range(5, 45):
        network, address = ("main", "0xt0") if b % 3 else ("side", "0xt2" if b % 2 else "0xt9")
        value = BIG + b if b % 4 == 0 else b
        rows.append((network, address, [topic, who(b % 5), who(b * 7 % 6)], f"0x{value:064x}", b, f"h{b}", f"t{b}", 1, b % 3, False))
    df = spark.createDataFrame(rows, "network string, address string, topics array<string>, data string, block_number long, block_hash string, tx_hash string, tx_index long, log_index long, removed boolean")
    df = df.withColumns({"chain_id": F.lit(1).cast("long"), "parent_hash": F.lit(""), "block_timestamp": F.timestamp_seconds(F.col("block_number") * 12)})
    return df.select(*(f.split()[0] for f in logs.RAW_LOG.split(", "))).cache()


def expected(df, out=lambda r: False):
    balances, history = {}, []
    for r in sorted(df.collect(), key=lambda r: r["block_number"]):
        fits = r["network"] == "main" and r["address"] == "0xt0" and r["block_number"] >= 10 or r["network"] == "side" and r["address"] in ("0xt1", "0xt2")
        if not fits or out(r):
            continue
        sender, to = ("0x" + t[26:] for t in r["topics"][1:])
        value = int(r["data"], 16)
        for who, sign in ((to, 1), (sender, -1)):
            old = balances.get((r["network"], who), (0, 0))
            balances[r["network"], who] = (old[0] + sign * value, old[1] + 1, r["block_number"], r["tx_hash"], r["address"])
        history.append((to, value * 3 if value * 3 < u256.TOP else None))
    return balances, sorted(history)


def prices(asked):
    return asked.withColumn("result", F.concat(F.lit("0x"), F.lpad(F.lit("9"), 64, "0"), F.lpad(F.lit("3"), 64, "0")))


def found(runner):
    rows = runner.table("balances").read().withColumn("text", u256.to_decimal(F.col("balance"))).collect()
    balances = {(r["network"], r["holder"]): (int(r["text"]), r["n"], r["block_number"], r["tx_hash"], r["contract_address"]) for r in rows}
    assert all(r["block_timestamp"].timestamp() == 12 * r["block_number"] for r in rows)
    history = runner.table("history").read().select("holder", u256.to_decimal(F.col("worth")).alias("worth")).collect()
    return balances, sorted((r["holder"], int(r["worth"])) for r in history)


def test_program_from_yaml_to_tables(spark, tmp_path):
    df = raw_logs(spark)
    program = manifest.load(PROGRAM)
    box, events = [], []
    make = lambda: Runner(spark, program, str(tmp_path / "root"), {"box": lambda m, b: box.extend(json.loads(r["message"]) for r in m.collect())}, prices, [lambda m, h: events.append((m, sorted(r[0] for r in h.collect())))], 4)
    for k in range(4):  # a new run for each file: restarts
        df.where(F.col("block_number") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        runner = make()
        runner.run(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).awaitTermination()
    assert found(runner) == expected(df)
    raw = runner.raw("Token", "Transfer").read()
    assert raw.count() == len(expected(df)[1]) and raw.where("evt_block_number < 10 and network = 'main'").count() == 0
    assert len(box) == sum(v >= BIG for _, v in ((r["to"], int(r["value"])) for r in raw.collect()))
    assert all(m["event_name"] == "Transfer" and int(m["event_data"]["value"]) >= BIG and m["transaction"]["network"] for m in box)
    runner.run_batch(df, 0)  # a repeated batch changes nothing
    assert found(runner) == expected(df)
    gone = lambda r: r["network"] == "main" and 20 <= r["block_number"] <= 30
    runner.reorg(df, "main", 20, 30, 1)
    assert found(runner) == expected(df, gone)
    message, hashes = events[0]
    assert message["event_data"]["fork_block"] == 20 and hashes == sorted(r["tx_hash"] for r in df.collect() if gone(r))
    assert runner.raw("Token", "Transfer").read().count() == len(expected(df, gone)[1])
    runner.reorg(df, "main", 20, 30, 1)  # done already
    assert found(runner) == expected(df, gone)
    again = df.where("network = 'main' and block_number between 20 and 30")  # the new chain has the same events
    runner.run_batch(again, runner.table("balances").batch + 1)
    balances, history = found(runner)
    want, lines = expected(df)
    assert {k: v[:2] for k, v in balances.items()} == {k: v[:2] for k, v in want.items()} and history == lines


def test_buckets_are_rewritten_only_where_touched(spark, tmp_path):
    t = manifest.table({"name": "t", "columns": [{"name": "k", "type": "int64"}, {"name": "n", "type": "int64"}], "events": [{"event": "log", "operations": [
        {"type": "upsert", "where": {"k": "$k"}, "if": "x > 0", "set": [{"column": "n", "action": "increment"}]}, {"type": "delete", "where": {"k": "$k"}, "if": "x == 0"}]}]})
    rows = lambda ks, seq, x=1: spark.createDataFrame([(k, seq, x, "m") for k in ks], "k long, evt_seq long, x long, network string")
    store = Store(spark, str(tmp_path / "t"), 8)
    live.fold_into(store, {"log": rows([*range(20), None], 1)}, t, 0)
    before = store._pointer()["folders"]
    live.fold_into(store, {"log": rows([3], 2)}, t, 1)
    after = store._pointer()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r["k"]: r["n"] for r in store.read().collect()} == {k: 2 if k == 3 else 1 for k in [*range(20), None]}
    live.fold_into(store, {"log": rows([*range(20), None], 3, 0)}, t, 2)
    assert store.read().count() == 0
    store.vacuum()
    live.fold_into(store, {"log": rows([5], 4)}, t, 3)
    assert [tuple(r) for r in store.read().select("k", "n").collect()] == [(5, 1)]


def test_released_events_come_again(spark, tmp_path):
    buffer = live.FinalBuffer(Store(spark, str(tmp_path / "b")), distance=0)
    blocks = lambda *b: spark.createDataFrame([(x,) for x in b], "block_number long")
    assert buffer.push(blocks(9, 10), 9, 0).count() == 1
    for _ in range(2):  # delivery failed after the first push
        assert [r[0] for r in buffer.push(blocks(11, 12), 11, 1).collect()] == [10, 11]
    buffer.discard(12, 12, 1)
    buffer.discard(12, 12, 1)
    assert [r[0] for r in buffer.push(blocks(13), 13, 2).collect()] == [13]


def test_retries_and_failed_batches(spark, tmp_path):
    tries, dead = [], []

    def sink(df, batch):
        tries.append(batch)
        if len(tries) < 3:
            raise OSError

    live.retried(sink, 3, 0.001)(None, 7)
    assert tries == [7, 7, 7]
    with pytest.raises(ZeroDivisionError):
        live.retried(lambda df, batch: 1 / 0, 2, 0.001)(None, 0)
    live.fold_batch(spark.range(3), 4, [], lambda df: {}, [lambda df, batch: 1 / 0], lambda df, batch, e: dead.append((df.count(), batch, type(e))))
    assert dead == [(3, 4, ZeroDivisionError)]


def test_heartbeat():
    now = [0.0]
    beat = live.Heartbeat(10, lambda: now[0])
    beat.beat(5)
    assert beat.status() == "alive"
    beat.beat(0)
    assert beat.status() == "silent"
    now[0] = 11
    assert beat.status() == "stalled"


class _Posts(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):  # noqa: N802
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        self.seen.append((self.path, self.headers.get("x-shared-secret") or self.headers.get("Authorization"), json.loads(body)))
        self.send_response(500 if self.path == "/bad" else 200)
        self.end_headers()

    def log_message(self, *_):
        pass


class _Redis(socketserver.StreamRequestHandler):
    seen: list = []

    def handle(self):
        while line := self.rfile.readline():
            words = []
            for _ in range(int(line[1:])):
                n = int(self.rfile.readline()[1:])
                words.append(self.rfile.read(n + 2)[:n].decode())
            self.seen.append(words)
            self.wfile.write(b"$3\r\n1-0\r\n" if words[1] == "ok" else b"-ERR no\r\n")


@pytest.fixture
def servers():
    web, redis = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Posts), socketserver.ThreadingTCPServer(("127.0.0.1", 0), _Redis)
    for s in (web, redis):
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", redis.server_address[1]
    for s in (web, redis):
        s.shutdown()
        s.server_close()


def test_senders(spark, servers):
    url, port = servers
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',)], "message string").coalesce(1)
    sinks.to(sinks.webhook(f"{url}/hook", "s3"))(df, 0)
    sinks.to(sinks.queue(f"{url}/queue", "tok"))(df, 0)
    sinks.to(sinks.chat_message(f"{url}/chat", "content", channel="c"))(df, 0)
    assert _Posts.seen[:2] == [("/hook", "s3", {"a": 1}), ("/hook", "s3", {"a": 2})]
    assert _Posts.seen[2] == ("/queue", "Bearer tok", {"messages": [{"body": {"a": k}, "content_type": "json"} for k in (1, 2)]})
    assert _Posts.seen[3][2] == {"channel": "c", "content": '{"a": 1}'}
    with pytest.raises(OSError):
        sinks.to(sinks.webhook(f"{url}/bad"))(df, 0)
    sinks.to(sinks.redis_stream("127.0.0.1", port, "ok"))(df, 0)
    assert _Redis.seen == [["XADD", "ok", "*", "message", f'{{"a": {k}}}'] for k in (1, 2)]
    with pytest.raises(OSError):
        sinks.to(sinks.redis_stream("127.0.0.1", port, "full"))(df, 0)


def test_signed_words_and_native_decoding(spark):
    event = abi.Event("E", (abi.Param("a", "int256"), abi.Param("b", "uint256"), abi.Param("c", "int8", True)))
    word = lambda v: f"{v % u256.TOP:064x}"
    values = [(-1, 0, 5), (-(1 << 255), u256.TOP - 1, -128), ((1 << 255) - 1, 1 << 128, 0), (123456789, 10**18, -7)]
    df = spark.createDataFrame([([event.topic, "0x" + word(c)], "0x" + word(a) + word(b)) for a, b, c in values], "topics array<string>, data string")
    native, python = ([tuple(map(int, r)) for r in f(df, event).collect()] for f in (abi.decode_static, abi.decode_logs))
    assert native == python == values


def test_wide_columns_in_folds(spark):
    t = manifest.table({"name": "t", "columns": [{"name": "k", "type": "int64"}, {"name": "v", "type": "uint256"}, {"name": "s", "type": "uint256", "default": 5}], "events": [{"event": "log", "operations": [
        {"type": "upsert", "where": {"k": "$k"}, "set": [{"column": "v", "value": "$v"}, {"column": "s", "action": "subtract", "value": "$v"}]}]}]})
    df = spark.createDataFrame([(1, 1, str(u256.TOP - 1), "m"), (2, 2, "0x10", "m"), (2, 3, "7", "m")], "k long, evt_seq long, v string, network string")
    state = fold.fold({"log": df.where("evt_seq < 3")}, t)
    got = fold.fold({"log": df.where("evt_seq = 3")}, t, state).select("k", *(u256.to_decimal(F.col(c)).alias(c) for c in "vs")).collect()
    assert {r["k"]: (int(r["v"]), int(r["s"])) for r in got} == {1: (u256.TOP - 1, 6 - u256.TOP), 2: (7, 5 - 23)}
