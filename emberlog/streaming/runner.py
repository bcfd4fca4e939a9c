"""From a manifest to tables: raw logs are decoded, stored, folded and sent on, batch by batch."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.names import snake
from emberlog.operators import messages, scan, schedule
from emberlog.operators.cron import synthetic, ticks
from emberlog.operators.fold import SEQ, Results, sequence_id
from emberlog.plans.manifest import Cron, ManifestError, Table
from emberlog.sources import abi
from emberlog.streaming.live import Sink, fold_into, roll_back
from emberlog.streaming.state import Store

#: Columns of a raw log and what events carry them as.
META = {
    "block_number": "evt_block_number", "tx_index": "evt_tx_index", "log_index": "evt_log_index", "tx_hash": "evt_tx_hash",
    "block_hash": "evt_block_hash", "address": "evt_contract_address", "block_timestamp": "evt_block_timestamp",
}


class Runner:
    """Runs a program of manifest.load() under a root folder that all executors share.

    Raw events of include_events go to raw/<contract>/<event>, tables to tables/<name>. sinks names what
    the manifest's streams are sent to; results answers view calls. A batch that a table has is skipped there, so
    a restarted run ends as one that never stopped.
    """

    def __init__(self, spark: SparkSession, program: dict, root: str, sinks: Mapping[str, Sink] | None = None, results: Results | None = None, on_reorg: list[Callable] = (), buckets: int = 64):
        self.spark, self.program, self.root = spark, program, root.rstrip("/")
        self.sinks, self.results, self.on_reorg, self.buckets = dict(sinks or {}), results, list(on_reorg), buckets
        self.constants = program.get("constants") or {}

    def table(self, name: str) -> Store:
        return Store(self.spark, f"{self.root}/tables/{snake(name)}", self.buckets)

    def raw(self, contract: str, event: str) -> Store:
        return Store(self.spark, f"{self.root}/raw/{snake(contract)}/{snake(event)}")

    def logs_of(self, contract: dict, logs: DataFrame) -> DataFrame:
        """The contract's logs: of its networks, addresses and blocks, none that a node has taken back."""
        out = None
        for d in contract.get("details", []):
            part = scan.block_range(logs.where(F.col("network") == d["network"]), "block_number", d.get("start_block") and int(d["start_block"]), d.get("end_block") and int(d["end_block"]))
            wanted = d.get("address")
            part = scan.addresses(part, "address", [wanted] if isinstance(wanted, str) else wanted)
            out = part if out is None else out.unionByName(part)
        return (logs if out is None else out).where(~F.coalesce("removed", F.lit(False)))

    def events_of(self, contract: dict, logs: DataFrame) -> dict[str, DataFrame]:
        """event -> its decoded logs with metadata and sequence."""
        own = self.logs_of(contract, logs)
        out = {}
        for name, event in contract["events"].items():
            meta = own.select("network", "topics", "data", *(F.col(c).alias(n) for c, n in META.items()))
            out[name] = abi.decoded(meta, event).withColumn(SEQ, sequence_id())
        return out

    def run_batch(self, logs: DataFrame, batch: int) -> None:
        """One batch of raw logs (sources.logs.RAW_LOG) into everything."""
        logs.persist()
        try:
            for contract in self.program.get("contracts", []):
                events = self.events_of(contract, logs)
                for name in contract.get("include_events") or []:
                    self.raw(contract["name"], name).append(events[name].drop(SEQ), batch)
                for table in contract["tables"]:
                    if not any(e.name in events for e in table.events):
                        continue
                    fold_into(self.table(table.name), events, table, batch, self.constants, self.results)
                for stream in contract.get("streams") or []:
                    self._send(stream, events, batch)
        finally:
            logs.unpersist()

    def _sampled(self, contract: dict, cron: Cron) -> DataFrame:
        """(network, evt_contract_address, contract) of what a cron samples: the addresses that the manifest lists, null where it lists none."""
        rows = []
        for d in contract.get("details", []):
            if cron.network in (None, d["network"]):
                wanted = d.get("address")
                rows += [(d["network"], a.lower() if a else None) for a in ([wanted] if wanted is None or isinstance(wanted, str) else wanted)]
        own = self.spark.createDataFrame(rows, "network string, evt_contract_address string")
        return own.withColumn("contract", F.col("evt_contract_address"))

    def tick(self, at: datetime.datetime, heads: Mapping[str, int], due: str | None = None) -> None:
        """Live samples at a time: the operations of all crons (or of those that are due by this text), at each network's head.

        Call it between batches, not beside them. A time that a table has sampled is not sampled again.
        """
        for contract, table, cron in self._crons():
            if cron.end is not None or due not in (None, cron.due):
                continue
            head = F.lit(None).cast("long")
            for network, block in heads.items():
                head = F.when(F.col("network") == network, block).otherwise(head)
            rows = schedule.live_rows(self._sampled(contract, cron), head, at).where("evt_block_number is not null")
            self._sample(table, cron, rows, int(at.timestamp() * 1000))

    def replay(self, heads: Mapping[str, int]) -> None:
        """Samples the history of all crons that name a start: every so many blocks from there to their end or the head, each table once."""
        for contract, table, cron in self._crons():
            if cron.start is None:
                continue
            head = F.lit(None).cast("long")
            for network, block in heads.items():
                head = F.when(F.col("network") == network, block if cron.end is None else min(block, cron.end)).otherwise(head)
            ranges = self._sampled(contract, cron).withColumns({"start": F.lit(cron.start), "end": head})
            rows = synthetic(ticks(ranges, cron.every)).withColumn("evt_block_timestamp", F.lit(None).cast("timestamp"))
            self._sample(table, cron, rows, 0)

    def _crons(self) -> Iterator[tuple[dict, Table, Cron]]:
        for contract in self.program.get("contracts", []):
            for table in contract["tables"]:
                for cron in table.crons:
                    yield contract, table, cron

    def _sample(self, table: Table, cron: Cron, rows: DataFrame, mark: int) -> None:
        store = self.table(table.name)
        if store.meta.get(cron.event, -1) < mark:
            fold_into(store, {cron.event: rows.withColumn(SEQ, sequence_id())}, table, None, self.constants, self.results, {cron.event: mark})

    def _send(self, stream: dict, events: Mapping[str, DataFrame], batch: int) -> None:
        for e in stream["events"]:
            df = events[e["event_name"]].withColumn("event_name", F.lit(e["event_name"]))
            routed = messages.routed(df, [e])
            payload = [c for c in events[e["event_name"]].columns if c not in (*META.values(), SEQ, "network")]
            out = messages.event_json(routed.orderBy(SEQ), e.get("alias", e["event_name"]), payload, ["network", *META.values()])
            self.sinks[stream["sink"]](out.select("message"), batch)

    def run(self, stream: DataFrame, once: bool = True) -> StreamingQuery:
        """Runs over a stream of raw logs, from where the last run under this root ended."""
        writer = stream.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="200 milliseconds")).start()

    def reorg(self, logs: DataFrame, network: str, fork: int, until: int, number: int) -> None:
        """Takes back a network's blocks from fork to until. logs: all raw logs so far, the orphaned ones among them.

        Tables of crons alone stay as they are. One of events and crons can't be folded anew from logs: that raises, before anything is changed.
        """
        both = [t.name for c in self.program.get("contracts", []) for t in c["tables"] if t.crons and len(t.crons) < len(t.events)]
        if both:
            raise ManifestError(f"tables of events and crons can't be rolled back: {', '.join(both)}")
        for contract in self.program.get("contracts", []):
            events = self.events_of(contract, logs)
            gone = (F.col("network") == network) & F.col("evt_block_number").between(fork, until)
            for name in contract.get("include_events") or []:
                store = self.raw(contract["name"], name)
                kept = store.read()
                if kept is not None and store.meta.get("reorg", -1) < number:
                    store.replace(kept.where(~gone), {"reorg": number})
            # Blocks of other networks stay: they are put out of the range's reach.
            own = {n: e.withColumn("_block", F.when(F.col("network") == network, F.col("evt_block_number")).otherwise(-1)) for n, e in events.items()}
            tables = [(t, self.table(t.name)) for t in contract["tables"] if not t.crons]
            roll_back(tables, own, "_block", fork, until, number, self.on_reorg, network, "evt_tx_hash", self.constants, self.results)
