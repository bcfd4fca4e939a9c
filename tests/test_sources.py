"""ABI decoding, 256-bit numbers, sources, sinks, streaming."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog.functions import names, u256
from emberlog.functions.keccak import keccak256
from emberlog.operators import fold
from emberlog.plans import manifest
from emberlog.sources import abi, logs, sinks
from emberlog.streaming import live
from emberlog.streaming.state import Store


def test_keccak_and_names():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"a" * 300) != keccak256(b"a" * 301)
    assert names.snake("tokenIdHTTPServer2") == "token_id_http_server2" and names.camel("my_name") == "myName" and names.pascal("my_name") == "MyName"
    assert names.short("a" * 63) == "a" * 63 and len(names.short("a" * 64)) == 63


def test_u256(spark):
    rng = random.Random(4)
    top = u256.TOP
    pairs = [(top - 1, 1), (5, 7), (0, 0), (top - 1, top - 1), *((rng.getrandbits(rng.choice([8, 64, 200, 256])), rng.getrandbits(rng.choice([8, 60, 130]))) for _ in range(40))]
    df = spark.createDataFrame([(k, str(a), str(b)) for k, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.select("i", u256.from_decimal(F.col("a")).alias("a"), u256.from_decimal(F.col("b")).alias("b")).cache()
    a, b = F.col("a"), F.col("b")
    out = df.select("i", u256.add(a, b).alias("add"), u256.subtract(a, b).alias("sub"), u256.multiply(a, b).alias("mul"), u256.divide(a, b).alias("div"), (a < b).alias("lt"), u256.to_decimal(a).alias("text"))
    keep = lambda v: f"{v:064x}" if v is not None and 0 <= v < top else None
    for r in out.collect():
        x, y = pairs[r["i"]]
        assert (r["add"], r["sub"], r["mul"], r["div"]) == (keep(x + y), keep(x - y), keep(x * y), keep(x // y if y else None))
        assert r["lt"] == (x < y) and r["text"] == str(x)
    assert df.where("i > 3").agg(u256.total(b).alias("t")).first()["t"] == keep(sum(y for _, y in pairs[4:]))
    assert spark.range(1).select(u256.from_hex(F.lit("0xFF")).alias("x"), u256.from_hex(F.lit("zz")).alias("y"), u256.power(u256.from_long(F.lit(2)), u256.from_long(F.lit(255))).alias("z")).first() == (f"{255:064x}", None, f"{2**255:064x}")


TRANSFER = {"type": "event", "name": "Transfer", "inputs": [{"name": "from", "type": "address", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]}
RICH = {
    "type": "event", "name": "Rich",
    "inputs": [
        {"name": "note", "type": "string", "indexed": True}, {"name": "ids", "type": "uint256[]"}, {"name": "text", "type": "string"}, {"name": "pair", "type": "tuple", "components": [{"name": "a", "type": "int8"}, {"name": "b", "type": "bytes"}]},
        {"name": "two", "type": "bool[2]"}, {"name": "tag", "type": "bytes4"},
    ],
}


def word(v: int) -> str:
    return f"{v % (1 << 256):064x}"


def test_abi(spark):
    events = abi.load_events(json.dumps([TRANSFER, RICH]))
    t, rich = events["Transfer"], events["Rich"]
    assert t.topic == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert rich.signature == "Rich(string,uint256[],string,(int8,bytes),bool[2],bytes4)"
    a, b = "0x" + "00" * 12 + "aa" * 20, "0x" + "00" * 12 + "bb" * 20
    schema = "n int, topics array<string>, data string"
    rows = [(1, [t.topic, a, b], "0x" + word(2**256 - 1)), (2, [t.topic, a], "0x" + word(1)), (3, [t.topic, a, b], "0x"), (4, ["0x00"], "0x")]
    got = abi.decode_logs(spark.createDataFrame(rows, schema), t).collect()
    assert [tuple(r) for r in got] == [(1, "0x" + "aa" * 20, "0x" + "bb" * 20, str(2**256 - 1))]
    native = abi.decode_static(spark.createDataFrame(rows, schema), t).collect()
    assert [tuple(r) for r in native] == [(1, "0x" + "aa" * 20, "0x" + "bb" * 20, str(2**256 - 1))]
    head = word(6 * 32) + word(9 * 32) + word(11 * 32) + word(1) + word(0) + "deadbeef" + "0" * 56
    body = word(2) + word(7) + word(8) + word(3) + b"h\xc3\xa9".hex().ljust(64, "0") + word(-5) + word(64) + word(2) + "cafe".ljust(64, "0")
    got = abi.decode_logs(spark.createDataFrame([(1, [rich.topic, "0x" + "12" * 32], "0x" + head + body)], schema), rich).first()
    assert got["note"] == "0x" + "12" * 32 and got["ids"] == ["7", "8"] and got["text"] == "hé" and tuple(got["pair"]) == ("-5", "0xcafe") and got["two"] == [True, False] and got["tag"] == "0xdeadbeef"


def test_calls_are_asked_once_and_joined_back(spark):
    from emberlog.plans import calls, expr, values

    text = '$call($token, "balanceOf(address) returns (uint256)", $holder) * 2 + $call_static($token, "pair()")[1]'
    first, second = calls.find_calls(text)
    assert first.selector == "70a08231" and second.static and second.access == "[1]" and first.returns == ("uint256",)
    df = spark.createDataFrame([("m", 5, "0xAA", "0x" + "b" * 40), ("m", 5, "0xAA", "0x" + "b" * 40), ("m", 6, "0xAA", "0x" + "c" * 40)], "network string, evt_block_number long, token string, holder string")
    seen = []

    def results(asked):
        seen.append(asked.count())
        n = F.when(F.col("block").isNull(), 7).otherwise(F.col("block") * 10)
        return asked.withColumn("result", F.concat(F.lit("0x"), F.lpad(F.hex(n), 64, "0"), F.lpad(F.hex(n + 1), 64, "0")))

    out, rest = calls.resolve(df, text, results)
    assert seen == [2, 1] and rest == "$call_0 * 2 + $call_1"
    got = out.select(values.compile_value(rest, "int64", expr.resolver(out.schema)).alias("x"))
    assert sorted(r["x"] for r in got.collect()) == [108, 108, 128]
    for bad in ('$call($a, "f(", 1)', '$call($a, "f(uint8)")', '$call($a, "f()"'):
        with pytest.raises(expr.ExprError):
            calls.find_calls(bad)


def test_guessed_results():
    assert abi.guess(bytes.fromhex(word(5))) == "5" and abi.guess(bytes.fromhex(word(5) + word(6))) == ("5", "6")
    assert abi.guess(b"DAI".ljust(32, b"\0")) == "DAI" and abi.guess(b"") == "0x"
    assert abi.guess(bytes.fromhex(word(32) + word(4)) + b"Name".ljust(32, b"\0")) == "Name"
    assert abi.guess(bytes.fromhex(word(32) + word(2) + "ff01".ljust(64, "0"))) == "0xff01"


def test_block_table_reads_in_shares_and_streams(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("block_number"), (F.col("id") % 7).alias("x")).repartition(3).write.parquet(str(tmp_path / "t"))
    logs.register(spark)
    read = lambda **o: spark.read.format("blocktable").options(path=str(tmp_path / "t"), **{k: str(v) for k, v in o.items()}).load()
    assert read().count() == 5000
    parallel = read(start=100, end=4000, workers=4)
    assert parallel.rdd.getNumPartitions() == 4 and parallel.agg(F.sum("block_number")).first()[0] == sum(range(100, 4001))
    assert read(distance=64).agg(F.max("block_number")).first()[0] == 4999 - 64
    assert logs.shares(5, 4) == [] and logs.shares(0, 10) == [(0, 10)] and logs.shares(0, 99_999)[-1][1] == 99_999
    q = spark.readStream.format("blocktable").options(path=str(tmp_path / "t"), distance="64").load().writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("blocks").count() == 5000 - 64


def test_csv_with_missing_fields(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n1,2,3\n4,5\n")
    assert [tuple(r) for r in logs.read_csv(spark, str(tmp_path / "x.csv"), "a int, b int, c int").collect()] == [(1, 2, 3), (4, 5, None)]


BALANCES = manifest.table({
    "name": "balances", "columns": [{"name": "k", "type": "int64"}, {"name": "total", "type": "int128"}, {"name": "last", "type": "int64"}],
    "events": [{"event": "log", "operations": [{"type": "upsert", "where": {"k": "$k"}, "set": [{"column": "total", "action": "add", "value": "$x"}, {"column": "last", "action": "set", "value": "$x"}]}]}],
})


def test_stream_fold_is_the_batch_fold_and_survives_restarts(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("evt_seq"), F.lit("m").alias("network"), (F.col("id") % 9).alias("k"), (F.col("id") * 7 % 31).alias("x"))
    want = {r["k"]: (int(r["total"]), r["last"]) for r in fold.fold({"log": rows}, BALANCES).collect()}
    src = tmp_path / "in"
    for n in range(4):
        rows.where(F.col("evt_seq").between(100 * n, 100 * n + 99)).coalesce(1).write.mode("append").parquet(str(src))
        store = Store(spark, str(tmp_path / "store"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        bad = lambda df, batch: 1 / 0  # noqa: E731  a failing sink does not stop the fold
        q = live.run_folds(stream, [(BALANCES, store)], lambda df: {"log": df}, str(tmp_path / "c"), [bad])
        q.awaitTermination()
    assert {r["k"]: (int(r["total"]), r["last"]) for r in store.read().collect()} == want
    again = store.read()
    live.fold_batch(rows, store.batch, [(BALANCES, store)], lambda df: {"log": df})  # a repeated batch changes nothing
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, again.collect()))
    live.roll_back([(BALANCES, store)], {"log": rows}, "evt_seq", 300, 350, store.batch + 1)
    left = fold.fold({"log": rows.where(~F.col("evt_seq").between(300, 350))}, BALANCES)
    assert {r["k"]: int(r["total"]) for r in store.read().collect()} == {r["k"]: int(r["total"]) for r in left.collect()} and store.meta["checkpoint"] == 299
    store.vacuum()
    assert store.read().count() == 9


def test_final_buffer(spark, tmp_path):
    buffer = live.FinalBuffer(Store(spark, str(tmp_path / "b")), distance=10)
    blocks = lambda a, b: spark.range(a, b).withColumnRenamed("id", "block_number")
    out = [r[0] for r in buffer.push(blocks(0, 20), 19, 0).collect()]
    assert out == list(range(10))
    buffer.discard(15, 17, 1)
    out = [r[0] for r in buffer.push(blocks(20, 30), 29, 2).collect()]
    assert out == [10, 11, 12, 13, 14, 18, 19]


def test_order_of_events_and_checkpoints():
    assert live.dependency_order({"b": ["a"], "c": ["a", "b"], "a": []}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        live.dependency_order({"a": ["b"], "b": ["a"]})
    assert live.monotone(5, 3) == 5 and live.monotone(None, 3) == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 5, "a"), ("m", 250_000, "b")], "network string, block_number long, message string")
    sinks.append_raw(df, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).where("block_bucket = 2").count() == 1
    assert sinks.append_once(df.unionAll(df), df.where("block_number = 5"), ["network", "block_number"]).count() == 1

    def send(texts):
        if "b" in texts:
            raise OSError

    assert {k: sum(r[k] for r in sinks.deliver(df, send, 1).collect()) for k in ("sent", "failed")} == {"sent": 1, "failed": 1}
    grown, unsafe = sinks.evolve(df, {"network": "string", "block_number": "int", "extra": "string"})
    assert "extra" in grown.columns and unsafe == ["message: gone", "block_number: bigint to int"]


def test_encoding_is_read_back():
    point = abi.Param("at", "tuple", False, (abi.Param("user", "uint64"), abi.Param("name", "string")))
    params = [abi.Param("a", "string"), abi.Param("b", "uint8[]"), abi.Param("c", "int16"), abi.Param("d", "bytes"), abi.Param("e", "string[2]"), point, abi.Param("f", "uint256[2][]"), abi.Param("g", "bytes4"), abi.Param("h", "address"), abi.Param("i", "bool")]
    rows = [
        ["", [], "-1", "0x", ["", ""], {"user": "0", "name": ""}, [], "0x00000000", "0x" + "0" * 40, False],
        ["é" * 40, ["1", "255"], "-32768", "0x" + "ab" * 33, ["x", "y" * 64], {"user": "7", "name": "n" * 32}, [["1", str(2**256 - 1)], ["0", "5"]], "0xdeadbeef", "0x" + "f" * 40, True],
    ]
    for row in rows:
        assert abi.decode(params, abi.encode(params, row)) == row
    for kind, v in [("uint8", 256), ("uint8", -1), ("int8", 128), ("uint256", "x"), ("uint8[2]", [1]), ("bytes4", "0x" + "00" * 5), ("address", 1 << 160), ("uint8[]", 5), ("string", None)]:
        with pytest.raises((abi.EncodeError, ValueError)):
            abi.encode([abi.Param("", kind)], [v])


def test_calls_take_text_arrays_and_negative_numbers(spark):
    from emberlog.plans import calls, expr

    df = spark.createDataFrame([("0xAA", "é" * 40, [1, 2], "0x0102"), ("0xAA", "", [], "0x"), ("0xAA", None, [300], "0x01")], "token string, s string, a array<int>, raw string")
    kinds = ["string", "uint8[]", "int8", "bytes", "bool", "uint16[2]"]
    (call,) = calls.find_calls(f"$call($token, \"f({','.join(kinds)})\", $s, $a, -1, $raw, true, '[3, 4]')")
    got = [r["data"] for r in df.select(calls.requested(call, expr.resolver(df.schema))[1].alias("data")).collect()]
    params = [abi.Param("", k) for k in kinds]
    for data, row in zip(got, [["é" * 40, [1, 2], -1, "0x0102", True, [3, 4]], ["", [], -1, "0x", True, [3, 4]]], strict=False):
        assert data == "0x" + call.selector + abi.encode(params, row).hex()
    assert got[2] is None  # a null, and a number too large for its type
