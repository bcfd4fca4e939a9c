"""Reading from a node, played by a local server that refuses wide ranges and fails now and then."""

from __future__ import annotations

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from emberlog.operators import scan
from emberlog.plans import calls
from emberlog.sources import node

HEAD = 2500
LOGS = [{"address": f"0xA{b % 2}", "topics": [scan.topic_of("T()"), scan.topic_of(str(b % 3))], "data": "0x", "blockNumber": hex(b), "blockHash": f"0xh{b}", "blockTimestamp": hex(1_700_000_000 + b), "transactionHash": f"0xt{b}", "transactionIndex": "0x1", "logIndex": "0x2", "removed": False} for b in range(0, HEAD + 1, 5)]


class _Node(http.server.BaseHTTPRequestHandler):
    count, refused, widths = 0, 0, []

    def answer(self, method, params):
        if method == "eth_blockNumber":
            return hex(HEAD)
        if method == "eth_chainId":
            return "0x5"
        if method == "eth_call":
            call, block = params
            if call["to"] == "0xbad":
                raise ValueError("reverted")
            return "0x" + f"{(7 if block == 'latest' else int(block, 16)) * 10:064x}"
        if method == "eth_getBlockByNumber":
            n = int(params[0], 16)
            return None if n > HEAD else {"number": params[0], "hash": f"0xh{n}", "parentHash": f"0xh{n - 1}", "timestamp": hex(1_700_000_000 + n)}
        wanted = params[0]
        a, b = int(wanted["fromBlock"], 16), int(wanted["toBlock"], 16)
        if b - a >= 300:
            type(self).refused += 1
            raise ValueError(f"too many results, try with this block range [{hex(a)}, {hex(a + 250)}]" if a % 2 else "range too wide")
        self.widths.append(b - a + 1)
        places = wanted.get("topics", [])
        return [x for x in LOGS if a <= int(x["blockNumber"], 16) <= b and x["address"] in wanted.get("address", [x["address"]]) and all(p is None or x["topics"][k] in p for k, p in enumerate(places))]

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).count += 1
        if self.count % 7 == 0:  # a node that is away now and then
            self.send_response(503)
            self.end_headers()
            return

        def one(q):
            try:
                return {"id": q["id"], "result": self.answer(q["method"], q["params"])}
            except ValueError as e:
                return {"id": q["id"], "error": {"code": -32005, "message": str(e)}}

        out = json.dumps([one(q) for q in reversed(body)] if isinstance(body, list) else one(body)).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def test_windows_shrink_and_grow():
    asked = []

    def fetch(a, b):
        asked.append((a, b))
        if b - a >= 40 or (50 <= a <= 60 and a != b):
            raise node.NodeError("no")
        return list(range(a, b + 1))

    assert [x for rows in node.windows(fetch, 3, 500, 100) for x in rows] == list(range(3, 501))
    assert max(b - a + 1 for a, b in asked) == 100 and any(a == b for a, b in asked)

    def named(a, b):
        if b - a > 4:
            raise node.NodeError(f"try [{hex(a)}, {hex(a + 4)}]")
        return [(a, b)]

    assert list(node.windows(named, 0, 11, 12)) == [[(0, 4)], [(5, 9)], [(10, 11)]]

    def never(a, b):
        raise node.NodeError("no")

    with pytest.raises(node.NodeError):
        list(node.windows(never, 0, 9))
    assert list(node.windows(never, 5, 4)) == []


def test_logs_of_a_node(spark, url, tmp_path):
    node.register(spark)
    read = lambda **o: spark.read.format("nodelogs").options(url=url, network="n", **{k: str(v) for k, v in o.items()}).load()
    rows = read(start=100, distance=500, workers=2, window=700).orderBy("block_number").collect()
    assert [r["block_number"] for r in rows] == list(range(100, 2001, 5)) and max(_Node.widths) <= 300 and _Node.refused
    first = rows[0]
    assert (first["network"], first["chain_id"], first["address"], first["tx_hash"], first["tx_index"], first["log_index"], first["removed"]) == ("n", 5, "0xa0", "0xt100", 1, 2, False)
    assert first["block_timestamp"].timestamp() % 1000 == 100
    some = read(start=0, end=299, address="0xA1", topics=json.dumps([["T()"], [1, 2]]))
    assert sorted(r["block_number"] for r in some.collect()) == [b for b in range(0, 300, 5) if b % 2 and b % 3]
    stream = spark.readStream.format("nodelogs").options(url=url, start="2000", distance="100").load()
    q = stream.writeStream.format("memory").queryName("nodelogs").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["block_number"] for r in spark.table("nodelogs").collect()) == list(range(2000, 2401, 5))


def test_calls_and_headers_of_a_node(spark, url):
    df = spark.createDataFrame([("n", 5, "0xaa"), ("n", 6, "0xaa"), ("n", 6, "0xBAD"), ("n", 6, None), ("other", 6, "0xaa")], "network string, evt_block_number long, token string")
    out, _ = calls.resolve(df, '$call($token, "f() returns (uint256)") + $call_static($token, "f() returns (uint256)")', node.call_results({"n": url}))
    got = sorted(((r["network"], r["evt_block_number"], r["token"], r["call_0"], r["call_1"]) for r in out.collect()), key=str)
    assert got == sorted([("n", 5, "0xaa", "50", "70"), ("n", 6, "0xaa", "60", "70"), ("n", 6, "0xBAD", None, None), ("n", 6, None, None, None), ("other", 6, "0xaa", None, None)], key=str)
    numbers = spark.createDataFrame([(3,), (3,), (2500,), (9999,), (None,)], "block_number long")
    rows = node.block_headers(numbers, url).withColumn("t", F.unix_timestamp("block_timestamp")).orderBy("block_number").collect()
    assert [(r["block_number"], r["block_hash"], r["parent_hash"], r["t"]) for r in rows] == [(3, "0xh3", "0xh2", 1_700_000_003), (2500, "0xh2500", "0xh2499", 1_700_002_500)]
    assert node.block_headers(numbers.where("block_number is null"), url).count() == 0
