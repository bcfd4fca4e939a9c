"""Reading from a node over JSON-RPC: logs as a batch and stream source, view calls and block times as lookups.

Only ranges, requests and block numbers are planned on the driver; the executors ask the node.
"""

from __future__ import annotations

import datetime
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader

from emberlog.operators.scan import topic_of
from emberlog.sources.logs import MAX_WORKERS, RAW_LOG, _Batch, _Stream

#: Blocks asked for at once at most, and requests sent in one body.
WINDOW, BODY = 10_000, 100
_RANGE = re.compile(r"\[\s*(0x[0-9a-f]+)\s*,\s*(0x[0-9a-f]+)\s*\]", re.I)


class NodeError(RuntimeError):
    """What a node answers instead of a result."""


class Node:
    """A JSON-RPC endpoint. Requests that do not get through are repeated, waiting twice as long each time."""

    def __init__(self, url: str, timeout: float = 30.0, attempts: int = 6, first_wait: float = 0.1):
        self.url, self.timeout, self.attempts, self.first_wait = url, timeout, attempts, first_wait

    def _send(self, body):
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"}, method="POST")
        for k in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except (OSError, ValueError) as e:
                if k + 1 == self.attempts or (isinstance(e, urllib.error.HTTPError) and e.code in (400, 401, 403, 404)):
                    raise
                time.sleep(self.first_wait * 2**k)

    def ask(self, method: str, *params):
        answer = self._send({"jsonrpc": "2.0", "id": 1, "method": method, "params": list(params)})
        if answer.get("error"):
            raise NodeError(answer["error"].get("message", "") + " " + str(answer["error"].get("data") or ""))
        return answer.get("result")

    def ask_all(self, method: str, requests: list[list]) -> list:
        """The results in order; None where the node answers with an error."""
        out: list = []
        for at in range(0, len(requests), BODY):
            part = requests[at : at + BODY]
            answers = self._send([{"jsonrpc": "2.0", "id": k, "method": method, "params": p} for k, p in enumerate(part)])
            if not isinstance(answers, list):
                raise NodeError(str(answers))
            found = {a["id"]: a.get("result") for a in answers}
            out += [found.get(k) for k in range(len(part))]
        return out

    def head(self) -> int:
        return int(self.ask("eth_blockNumber"), 16)


def windows(fetch: Callable[[int, int], list], start: int, end: int, most: int = WINDOW) -> Iterator[list]:
    """fetch(first, last) over start to end, in windows that shrink where the node refuses one and grow again after.

    A refusal that names a range is taken at its word if that is shorter, else the window halves. A single
    block that is refused raises.
    """
    size = most
    while start <= end:
        last = min(end, start + size - 1)
        try:
            rows = fetch(start, last)
        except NodeError as e:
            if last == start:
                raise
            named = _RANGE.search(str(e))
            to = int(named[2], 16) if named else -1
            size = to - start + 1 if start <= to < last else (last - start + 1) // 2
            continue
        yield rows
        start, size = last + 1, min(most, size * 2)


def _whole(text: str | None) -> int | None:
    return None if text is None else int(text, 16)


def _time(text: str | None) -> datetime.datetime | None:
    return None if text is None else datetime.datetime.fromtimestamp(int(text, 16), datetime.timezone.utc)


class NodeLogs(DataSource):
    """Logs of a node in the form of sources.logs.RAW_LOG, dealt out by block range.

    Options: url, network, address (one or several, by commas), topics (JSON: for each place null or a list of
    literals), start, end, distance (blocks to stay behind the head), window (blocks asked for at once),
    workers. As a stream its offset is the next block, and it never runs past head - distance.
    """

    @classmethod
    def name(cls) -> str:
        return "nodelogs"

    def schema(self) -> str:
        return RAW_LOG

    @cached_property
    def node(self) -> Node:
        return Node(self.options["url"])

    @cached_property
    def chain_id(self) -> int:
        return int(self.node.ask("eth_chainId"), 16)

    def workers(self) -> int:
        return int(self.options.get("workers", MAX_WORKERS))

    def bounds(self) -> tuple[int, int]:
        end = self.node.head() - int(self.options.get("distance", 0))
        if "end" in self.options:
            end = min(end, int(self.options["end"]))
        return int(self.options.get("start", 0)), end

    def _filter(self) -> dict:
        out: dict = {}
        if self.options.get("address"):
            out["address"] = [a.strip() for a in self.options["address"].split(",")]
        if self.options.get("topics"):
            out["topics"] = [None if place is None else [topic_of(t) for t in place] for place in json.loads(self.options["topics"])]
        return out

    def rows(self, part) -> Iterator[tuple]:
        if part.end < part.start:
            return
        wanted, network = self._filter(), self.options.get("network", "main")
        fetch = lambda a, b: self.node.ask("eth_getLogs", {**wanted, "fromBlock": hex(a), "toBlock": hex(b)})
        for logs in windows(fetch, part.start, part.end, int(self.options.get("window", WINDOW))):
            for x in logs:
                yield (
                    network, self.chain_id, x["address"].lower(), x["topics"], x["data"], _whole(x.get("blockNumber")), x.get("blockHash"),
                    None, _time(x.get("blockTimestamp")), x.get("transactionHash"), _whole(x.get("transactionIndex")), _whole(x.get("logIndex")), bool(x.get("removed")),
                )

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NodeLogs)


def call_results(urls: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """An answer to plans.calls.resolve(): asks the network's node for every request, at its block or the latest.

    A call that fails, or whose target or calldata is null, or of a network without a node, has a null result.
    """

    def answer(asked: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nodes = {n: Node(u) for n, u in urls.items()}
            for pdf in batches:
                out: list = [None] * len(pdf)
                rows = list(zip(pdf["network"], pdf["target"], pdf["calldata"], pdf["block"], strict=True))
                for network, node in nodes.items():
                    own = [k for k, (n, to, data, _) in enumerate(rows) if n == network and isinstance(to, str) and isinstance(data, str)]
                    params = [[{"to": rows[k][1], "data": rows[k][2]}, "latest" if pd.isna(rows[k][3]) else hex(int(rows[k][3]))] for k in own]
                    for k, result in zip(own, node.ask_all("eth_call", params), strict=True):
                        out[k] = result if result != "0x" else None
                yield pdf.assign(result=pd.Series(out, index=pdf.index, dtype=object))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
        return asked.mapInPandas(run, f"{kinds}, result string")

    return answer


def block_headers(numbers: DataFrame, url: str, number: str = "block_number") -> DataFrame:
    """(block_number, block_hash, parent_hash, block_timestamp) of the distinct numbers; blocks that the node does not know are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = Node(url)
        for pdf in batches:
            found = [b for b in node.ask_all("eth_getBlockByNumber", [[hex(int(n)), False] for n in pdf[number]]) if b]
            yield pd.DataFrame({
                "block_number": pd.Series([_whole(b["number"]) for b in found], dtype="int64"), "block_hash": [b["hash"] for b in found], "parent_hash": [b["parentHash"] for b in found],
                "block_timestamp": pd.Series([pd.Timestamp(_time(b["timestamp"])) for b in found], dtype="datetime64[ns, UTC]"),
            })

    asked = numbers.where(numbers[number].isNotNull()).select(number).distinct()
    return asked.mapInPandas(run, "block_number long, block_hash string, parent_hash string, block_timestamp timestamp")
