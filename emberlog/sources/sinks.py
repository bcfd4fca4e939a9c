"""Sinks: raw tables, CSV, Kafka, and callbacks for anything that takes messages."""

from __future__ import annotations

import json
import socket
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_raw(df: DataFrame, path: str, network: str = "network", block: str = "block_number", bucket: int = 100_000) -> None:
    """Appends to a table partitioned by network and bucket of blocks, so ranges and rollbacks touch few files."""
    df.withColumn("block_bucket", F.floor(F.col(block) / bucket)).write.mode("append").partitionBy(network, "block_bucket").parquet(path)


def append_once(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of df that a re-run has not written yet, each once."""
    return df.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_kafka(df: DataFrame, servers: str, topic: str, key: str | None = None, **options: str) -> None:
    """Messages (column `message`) to Kafka; needs the connector on the classpath."""
    rows = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.col("message").alias("value"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()


def deliver(df: DataFrame, send: Callable[[list[str]], None], batch: int = 100) -> DataFrame:
    """Calls send with lists of messages on the executors; one row for each partition: (sent, failed).

    What send raises counts as failed and does not stop the job. Sends may repeat when a task does, so
    messages carry ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = failed = 0
        for pdf in batches:
            texts = pdf["message"].tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    send(part)
                    sent += len(part)
                except Exception:  # noqa: BLE001
                    failed += len(part)
        yield pd.DataFrame({"sent": [sent], "failed": [failed]})

    return df.select("message").mapInPandas(run, "sent long, failed long")


def evolve(stored: DataFrame, wanted: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """The stored table with columns added as null, and what else differs: removals and type changes, which need a hand."""
    have = dict(stored.dtypes)
    unsafe = [f"{c}: gone" for c in have if c not in wanted] + [f"{c}: {have[c]} to {t}" for c, t in wanted.items() if c in have and have[c] != t]
    return stored.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in have}), unsafe


# --- senders for deliver(): called on the executors with a list of messages -----------------------


def webhook(url: str, secret: str = "", header: str = "x-shared-secret", timeout: float = 10.0) -> Callable[[list[str]], None]:
    """POSTs each message as JSON, with a shared secret in a header. An answer beyond 2xx is an error."""

    def send(texts: list[str]) -> None:
        for text in texts:
            _post(url, text.encode(), {header: secret} if secret else {}, timeout)

    return send


def queue(url: str, token: str, timeout: float = 10.0) -> Callable[[list[str]], None]:
    """POSTs messages in one request, as HTTP queue services take them: {"messages": [{"body": …}, …]}."""

    def send(texts: list[str]) -> None:
        body = json.dumps({"messages": [{"body": json.loads(t), "content_type": "json"} for t in texts]})
        _post(url, body.encode(), {"Authorization": f"Bearer {token}"}, timeout)

    return send


def chat_message(url: str, text_key: str = "text", timeout: float = 10.0, **fields: str) -> Callable[[list[str]], None]:
    """POSTs each text to a chat service's hook: the text under text_key (`text`, `content`, …) beside fixed fields."""

    def send(texts: list[str]) -> None:
        for text in texts:
            _post(url, json.dumps({**fields, text_key: text}).encode(), {}, timeout)

    return send


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> None:
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", **headers}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # raises on 4xx and 5xx
        answer.read()


def redis_stream(host: str, port: int, stream: str, field: str = "message", timeout: float = 10.0) -> Callable[[list[str]], None]:
    """Adds each message to a Redis stream (XADD), all of a list in one round trip."""

    def send(texts: list[str]) -> None:
        words = lambda *w: b"*%d\r\n" % len(w) + b"".join(b"$%d\r\n%s\r\n" % (len(x), x) for x in w)
        with socket.create_connection((host, port), timeout) as s, s.makefile("rb") as answers:
            s.sendall(b"".join(words(b"XADD", stream.encode(), b"*", field.encode(), t.encode()) for t in texts))
            for _ in texts:
                line = answers.readline()
                if not line.startswith(b"$"):
                    raise OSError(line.decode("utf-8", "replace"))
                answers.read(int(line[1:]) + 2)

    return send


def rabbitmq(url: str, exchange: str, routing_key: str) -> Callable[[list[str]], None]:
    """Publishes to an exchange; needs the pika package on the executors."""

    def send(texts: list[str]) -> None:
        import pika

        connection = pika.BlockingConnection(pika.URLParameters(url))
        try:
            channel = connection.channel()
            channel.confirm_delivery()
            for text in texts:
                channel.basic_publish(exchange, routing_key, text.encode(), mandatory=True)
        finally:
            connection.close()

    return send


def sns(topic: str, **client: str) -> Callable[[list[str]], None]:
    """Publishes to an SNS topic; needs the boto3 package on the executors."""

    def send(texts: list[str]) -> None:
        import boto3

        service = boto3.client("sns", **client)
        for text in texts:
            service.publish(TopicArn=topic, Message=text)

    return send


def to(send: Callable[[list[str]], None], batch: int = 100) -> Callable[[DataFrame, int], None]:
    """A sink of streaming.live over a sender: raises if a message could not be sent, so that retried() sends the batch again."""

    def sink(df: DataFrame, number: int) -> None:
        failed = deliver(df, send, batch).agg(F.sum("failed")).first()[0]
        if failed:
            raise OSError(f"{failed} messages of batch {number} were not sent")

    return sink
