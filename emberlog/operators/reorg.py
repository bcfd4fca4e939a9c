"""Chain reorganisations: where the chain forks, what goes, and tables as if it had never been.

The log is the source of truth. Rows of keys that an orphaned event touched are folded anew from the surviving
events; all other rows stay as they are, so a retraction costs what it touches.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.fold import Results, by_key, fold, fold_rows, operation_rows
from emberlog.plans.manifest import Table

#: Blocks of one bucket.
SPAN = 100_000


def parent_mismatches(blocks: DataFrame, number: str = "block_number", own: str = "block_hash", parent: str = "parent_hash", by: list[str] | None = None) -> DataFrame:
    """Blocks whose parent hash is not the hash of the stored block before them."""
    by = by or []
    before = blocks.select(*by, (F.col(number) + 1).alias(number), F.col(own).alias("_h"))
    return blocks.join(before, [*by, number]).where(F.col("_h") != F.col(parent)).select(*blocks.columns)


def fork_points(stored: DataFrame, canonical: DataFrame, by: list[str], number: str = "block_number", own: str = "block_hash") -> DataFrame:
    """(by, fork): the first orphaned block: after the highest that both agree on, or the oldest stored if none."""
    other = canonical.select(*by, number, F.col(own).alias("_canonical"))
    met = stored.join(other, [*by, number], "left")
    agrees = F.col(own) == F.col("_canonical")
    points = met.groupBy(*by).agg(F.max(F.when(agrees, F.col(number))).alias("match"), F.min(number).alias("oldest"), F.count_if(~F.coalesce(agrees, F.lit(True))).alias("bad"))
    return points.where("bad > 0").select(*by, F.coalesce(F.col("match") + 1, F.col("oldest")).alias("fork"))


def removed_fork(logs: DataFrame, by: list[str], number: str = "block_number") -> DataFrame:
    """(by, fork): the lowest block of logs that the node marks as removed."""
    return logs.where("removed").groupBy(*by).agg(F.min(number).alias("fork"))


def survivors(events: DataFrame, block: str, fork: int, until: int | None = None) -> DataFrame:
    gone = F.col(block) >= fork if until is None else F.col(block).between(fork, until)
    return events.where(~gone)


def orphaned_transactions(events: DataFrame, block: str, fork: int, until: int | None = None, tx_hash: str = "tx_hash") -> DataFrame:
    gone = F.col(block) >= fork if until is None else F.col(block).between(fork, until)
    return events.where(gone).select(tx_hash).distinct()


def retract(state: DataFrame, events: Mapping[str, DataFrame], table: Table, block: str, fork: int, until: int | None = None, constants: Mapping | None = None, results: Results | None = None) -> DataFrame:
    """The stored rows after the blocks from fork (to until) are gone."""
    kept = {n: survivors(e, block, fork, until) for n, e in events.items()}
    if table.insert_only:
        return fold(kept, table, constants=constants, results=results)
    if not table.keys:
        return fold(kept, table, constants=constants, results=results)
    gone = {n: e.where(F.col(block) >= fork if until is None else F.col(block).between(fork, until)) for n, e in events.items()}
    touched = operation_rows(gone, table, constants, results).select(*table.keys).distinct()
    # Only the touched keys' rows are folded again; the others of the history are read and dropped before any shuffle
    # but that of the semi join, which broadcasts the touched keys where they are few.
    again = fold_rows(by_key(operation_rows(kept, table, constants, results), touched, table.keys, "left_semi"), table)
    return by_key(state, touched, table.keys, "left_anti").unionByName(again)


def rewound_checkpoint(last_synced: int, fork: int) -> int:
    return min(last_synced, fork - 1)


def reorg_message(network: str, fork: int, detected: int, hashes: list[str]) -> dict:
    """The control message that consumers get before the new blocks' events."""
    return {"event_name": "__reorg", "network": network, "event_data": {"fork_block": fork, "detected_block": detected, "tx_hashes": sorted(set(hashes))}}


def prune_window(blocks: DataFrame, by: list[str], keep: int, number: str = "block_number") -> DataFrame:
    """The newest `keep` block numbers of each chain."""
    heads = blocks.groupBy(*by).agg(F.max(number).alias("_head"))
    return blocks.join(heads, by).where(F.col(number) > F.col("_head") - keep).drop("_head")


def gaps(blocks: DataFrame, by: list[str], number: str = "block_number") -> DataFrame:
    """(by, first, last) of missing block numbers inside each chain's window.

    Blocks are ordered within buckets of SPAN numbers; only each bucket's first and last block meet those of others.
    """
    own = blocks.select(*by, F.col(number).alias("_n"), F.floor(F.col(number) / SPAN).alias("_b"))
    inside = own.select(*by, "_n", F.lead("_n").over(Window.partitionBy(*by, "_b").orderBy("_n")).alias("_next"))
    ends = own.groupBy(*by, "_b").agg(F.min("_n").alias("_low"), F.max("_n").alias("_high"))
    across = ends.select(*by, F.col("_high").alias("_n"), F.lead("_low").over(Window.partitionBy(*by).orderBy("_b")).alias("_next"))
    missing = inside.unionAll(across).where(F.col("_next") > F.col("_n") + 1)
    return missing.select(*by, (F.col("_n") + 1).alias("first"), (F.col("_next") - 1).alias("last"))
