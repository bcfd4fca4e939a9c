"""Cron expressions against a check of every second or minute, intervals, and the live loop with a clock of its own."""

from __future__ import annotations

import datetime

import pytest

from emberlog.operators import schedule

UTC = datetime.timezone.utc
START = datetime.datetime(2024, 2, 27, 22, 58, 30, tzinfo=UTC)


def at(*parts) -> datetime.datetime:
    return datetime.datetime(*parts, tzinfo=UTC)


@pytest.mark.parametrize(
    ("text", "fits"),
    [
        ("*/5 * * * *", lambda t: t.minute % 5 == 0),
        ("10-20/3,59 22,23 * * *", lambda t: t.minute in (10, 13, 16, 19, 59) and t.hour >= 22),
        ("0 0 29 feb *", lambda t: (t.month, t.day, t.hour, t.minute) == (2, 29, 0, 0)),
        ("30 6 * * mon-wed", lambda t: (t.hour, t.minute) == (6, 30) and t.weekday() < 3),
        ("0 12 1 * 5", lambda t: (t.hour, t.minute) == (12, 0) and (t.day == 1 or t.weekday() == 4)),
        ("0 3 L * *", lambda t: (t.hour, t.minute) == (3, 0) and (t + datetime.timedelta(days=1)).day == 1),
        ("15/20 * * * 7", lambda t: t.minute in (15, 35, 55) and t.weekday() == 6),
        ("@hourly", lambda t: t.minute == 0),
    ],
)
def test_times_are_those_that_fit(text, fits):
    end = START + datetime.timedelta(days=7)
    minute = START.replace(second=0)
    every = [minute + datetime.timedelta(minutes=k) for k in range(1, 7 * 24 * 60 + 1)]
    assert list(schedule.times(text, START, end)) == [t for t in every if t <= end and fits(t)]


def test_seconds_intervals_and_far_times():
    assert list(schedule.times("*/20 59 22 * * *", START, at(2024, 2, 28))) == [at(2024, 2, 27, 22, 59, s) for s in (0, 20, 40)]
    assert schedule.due_after("90s", START) == at(2024, 2, 27, 23, 0)
    assert schedule.Cron.parse("0 0 29 2 *").after(at(2024, 3, 1)) == at(2028, 2, 29)
    assert schedule.Cron.parse("0 0 * * *").after(at(2024, 3, 1)) == at(2024, 3, 2)
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "* * * foo *", "0 0 31 2 *", "", "5x"):
        with pytest.raises(ValueError):
            schedule.due_after(bad, START)


def test_live_loop_and_rows(spark):
    clock, seen = [START], []

    def sleep(seconds):
        clock[0] += datetime.timedelta(seconds=seconds)

    def act(due):
        seen.append((due.hour, due.minute))
        clock[0] += datetime.timedelta(minutes=7 if len(seen) == 2 else 0)  # one that takes long

    schedule.run("*/5 * * * *", act, at(2024, 2, 27, 23, 20), lambda: clock[0], sleep)
    assert seen == [(23, 0), (23, 5), (23, 15), (23, 20)]
    df = schedule.live_rows(spark.createDataFrame([("0xa",), ("0xb",)], "address string"), 77, at(2024, 1, 1))
    rows = df.collect()
    assert {r["address"] for r in rows} == {"0xa", "0xb"} and {r["evt_block_number"] for r in rows} == {77} and {r["evt_log_index"] for r in rows} == {0}
    assert {r["evt_tx_hash"] for r in rows} == {"0x" + "0" * 64} and all(r["evt_block_timestamp"].year == 2024 for r in rows)


PROGRAM = """
name: demo
networks: [{name: main}, {name: side}]
contracts:
  - name: Pool
    details: [{network: main, address: ["0xAA", "0xBB"]}, {network: side, address: "0xCC"}]
    abi: [{type: event, name: Used, inputs: [{name: x, type: uint256}]}]
    tables:
      - name: prices
        timestamp: true
        columns: [{name: pool, type: string}, {name: price, type: uint256}, {name: n, type: int64, default: 0}]
        cron:
          - interval: 5m
            operations:
              - {type: upsert, where: {pool: $contract}, set: [{column: price, value: '$call($contract, "price() returns (uint256)")'}, {column: n, action: increment}]}
      - name: samples
        columns: [{name: pool, type: string}, {name: at, type: int64}]
        cron:
          - schedule: "0 * * * *"
            network: main
            start_block: 10
            block_interval: 10
            operations: [{type: insert, set: [{column: pool, value: $contract}, {column: at, value: $evt_block_number}]}]
"""


def test_crons_of_a_program(spark, tmp_path):
    from pyspark.sql import functions as F

    from emberlog.functions import u256
    from emberlog.plans import manifest
    from emberlog.streaming.runner import Runner

    answered = lambda asked: asked.withColumn("result", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("block") * 2)), 64, "0")))
    make = lambda: Runner(spark, manifest.load(PROGRAM), str(tmp_path), results=answered, buckets=4)
    make().replay({"main": 35, "side": 100})
    make().replay({"main": 45, "side": 100})  # a restart samples no history again
    make().tick(at(2024, 1, 1, 0, 5), {"main": 40, "side": 100}, "5m")
    make().tick(at(2024, 1, 1, 0, 5), {"main": 41, "side": 101}, "5m")  # the same tick once more
    make().tick(at(2024, 1, 1, 1, 0), {"main": 50})
    runner = make()
    got = {(r["network"], r["pool"]): (r["p"], r["n"]) for r in runner.table("prices").read().withColumn("p", u256.to_decimal(F.col("price"))).collect()}
    assert got == {("main", "0xaa"): ("100", 2), ("main", "0xbb"): ("100", 2), ("side", "0xcc"): ("200", 1)}
    samples = sorted((r["pool"], r["at"]) for r in runner.table("samples").read().collect())
    assert samples == [(p, b) for p in ("0xaa", "0xbb") for b in (10, 20, 30, 50)]
    with pytest.raises(manifest.ManifestError):
        manifest.load(PROGRAM.replace("interval: 5m", "network: main"))
