"""Live indexing: micro-batches folded into versioned tables, finality, in-order delivery, roll-back."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from emberlog.operators.fold import Results, fold, fold_rows, in_order, merge, operation_rows, reduce_batch
from emberlog.operators.reorg import orphaned_transactions, reorg_message, retract
from emberlog.plans.manifest import Table
from emberlog.streaming.state import BUCKET, Store

Sink = Callable[[DataFrame, int], None]


def fold_into(store: Store, events: Mapping[str, DataFrame], table: Table, batch: int | None, constants: Mapping | None = None, results: Results | None = None, meta: dict | None = None) -> None:
    """One batch into a table: appended, or folded into the buckets that its keys fall into. batch None is beside the stream's batches."""
    if batch is not None and store.batch >= batch:
        return
    if table.insert_only:
        store.append(fold(events, table, None, constants, results), batch, meta)
        return
    if not table.keys:
        folded = fold(events, table, store.read(), constants, results)
        if batch is None:
            store.replace(folded, meta)
        else:
            store.write(folded, batch, meta)
        return
    rows = operation_rows(events, table, constants, results)
    ordered = in_order(table)
    reduced = (rows if ordered else reduce_batch(rows, table)).withColumn(BUCKET, store.bucket_of(table.keys)).persist()
    try:
        touched = [r[0] for r in reduced.select(BUCKET).distinct().collect()]  # at most as many as there are buckets
        state = store.read(touched)
        merged = fold_rows(reduced.drop(BUCKET), table, state) if ordered else merge(reduced.drop(BUCKET), table, state)
        store.merge_buckets(merged, touched, batch, table.keys, meta)
    finally:
        reduced.unpersist()


def retried(sink: Sink, attempts: int = 10, first: float = 0.1, most: float = 15.0) -> Sink:
    """A sink that is given a batch again, whole, after waits that double from first to most seconds. Sinks must bear repeats."""

    def run(df: DataFrame, batch: int) -> None:
        wait = first
        for left in range(attempts - 1, -1, -1):
            try:
                return sink(df, batch)
            except Exception:  # noqa: BLE001
                if not left:
                    raise
                time.sleep(wait)
                wait = min(2 * wait, most)

    return run


def fold_batch(
    df: DataFrame, batch: int, tables: list[tuple[Table, Store]], split: Callable[[DataFrame], Mapping[str, DataFrame]], sinks: list[Sink] = (),
    failed: Callable[[DataFrame, int, Exception], None] | None = None, constants: Mapping | None = None, results: Results | None = None,
) -> None:
    """One micro-batch into all tables and sinks. Tables skip a batch they have; a failing sink does not stop the rest.

    What a sink could not take goes to `failed` with the error (a dead-letter table, say); without it, it is printed.
    """
    df.persist()
    try:
        events = split(df)
        for table, store in tables:
            fold_into(store, events, table, batch, constants, results)
        for sink in sinks:
            try:
                sink(df, batch)
            except Exception as e:  # noqa: BLE001
                if failed:
                    failed(df, batch, e)
                else:
                    print(f"a sink failed on batch {batch}: {e}")
    finally:
        df.unpersist()


def run_folds(stream: DataFrame, tables: list[tuple[Table, Store]], split: Callable[[DataFrame], Mapping[str, DataFrame]], checkpoint: str, sinks: list[Sink] = (), once: bool = True, **more) -> StreamingQuery:
    """Folds a stream of logs into tables. The checkpoint and the tables' batch numbers make restarts exact."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: fold_batch(df, batch, tables, split, sinks, **more)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="200 milliseconds")).start()


class FinalBuffer:
    """Events held until their block is `distance` behind the head, then delivered in block order.

    What a batch releases is stored before the held events change, so a batch that is pushed again after a
    failure gets the same events.
    """

    def __init__(self, store: Store, block: str = "block_number", distance: int = 0):
        self.store, self.block, self.distance = store, block, distance
        self.released = Store(store.spark, f"{store.path}-released")

    def push(self, df: DataFrame, head: int, batch: int) -> DataFrame:
        """Takes a batch in and returns what is final now, in order; a repeated batch returns what it did before."""
        if self.store.batch < batch:
            held = self.store.read()
            every = df if held is None else held.unionByName(df)
            final = head - self.distance
            self.released.write(every.where(F.col(self.block) <= final), batch)
            self.store.write(every.where(F.col(self.block) > final), batch, {"head": head})
        return self.released.read().orderBy(self.block)

    def discard(self, fork: int, until: int, number: int) -> None:
        """Forgets held events of orphaned blocks. number counts reorganisations: one that is done is not done again."""
        held = self.store.read()
        if held is not None and self.store.meta.get("reorg", -1) < number:
            self.store.replace(held.where(~F.col(self.block).between(fork, until)), {"reorg": number})


def roll_back(
    tables: list[tuple[Table, Store]], events: Mapping[str, DataFrame], block: str, fork: int, until: int, number: int, on_reorg: list[Callable[[dict, DataFrame], None]] = (),
    network: str = "", tx_hash: str = "tx_hash", constants: Mapping | None = None, results: Results | None = None,
) -> None:
    """Tables without the blocks from fork to until, each in one pointer swap.

    number counts reorganisations, apart from batches: a table that has it is left alone. Then each hook of on_reorg gets
    the control message and the orphaned transactions, as a table of their hashes; a failing hook does not stop the others.
    """
    for table, store in tables:
        state = store.read()
        if state is not None and store.meta.get("reorg", -1) < number:
            left = retract(state, events, table, block, fork, until, constants, results)
            store.replace(left, {"checkpoint": fork - 1, "reorg": number}, None if table.insert_only else table.keys)
    for hook in on_reorg:
        gone = [orphaned_transactions(e, block, fork, until, tx_hash) for e in events.values() if tx_hash in e.columns]
        hashes = None
        for g in gone:
            hashes = g if hashes is None else hashes.union(g).distinct()
        try:
            hook(reorg_message(network, fork, until, []), hashes)
        except Exception as e:  # noqa: BLE001
            print(f"a reorganisation hook failed: {e}")


class Heartbeat(StreamingQueryListener):
    """Tells whether a stream moves: `status()` is alive after a batch with rows, silent after batches without, stalled
    if no batch ended for `patience` seconds."""

    def __init__(self, patience: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.patience, self.clock = patience, clock
        self.last, self.rows, self.error = clock(), None, None

    def onQueryStarted(self, event) -> None:
        self.last = self.clock()

    def onQueryProgress(self, event) -> None:
        self.beat(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.beat(0)

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception

    def beat(self, rows: int) -> None:
        self.last, self.rows = self.clock(), rows

    def status(self) -> str:
        if self.clock() - self.last > self.patience:
            return "stalled"
        return "alive" if self.rows else "silent"


def monotone(old: int | None, new: int) -> int:
    """Checkpoints only move on; roll_back() alone moves them back."""
    return new if old is None else max(old, new)


def dependency_order(parents: Mapping[str, list[str]]) -> list[list[str]]:
    """Events in levels: each after all those that it needs."""
    left, out, done = {k: set(v) for k, v in parents.items()}, [], set()
    for needs in parents.values():
        for n in needs:
            left.setdefault(n, set())
    while left:
        level = sorted(k for k, v in left.items() if v <= done)
        if not level:
            raise ValueError(f"events depend on each other: {sorted(left)}")
        out.append(level)
        done |= set(level)
        for k in level:
            del left[k]
    return out
