"""Timestamps of blocks: milliseconds or seconds, fixed spacing, run lengths, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.fold import running_deltas

__all__ = ["attach", "expand_runs", "fixed", "interpolate", "running_deltas", "seconds"]


def seconds(c: Column) -> Column:
    """Unix seconds, of seconds or of milliseconds."""
    return F.when(c > 1_000_000_000_000, F.floor(c / 1000)).otherwise(c).cast("long")


def fixed(block: Column, anchor_block: int, anchor_time: int, spacing: int) -> Column:
    """The time of a block on a chain of even spacing."""
    return (F.lit(anchor_time) + (block - F.lit(anchor_block)) * F.lit(spacing)).cast("long")


def attach(df: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """df with the block table's columns; df's rows all stay."""
    return df.join(blocks.dropDuplicates(on), on, "left")


def expand_runs(runs: DataFrame, first_times: DataFrame, by: list[str]) -> DataFrame:
    """(by, block, time) from running_deltas() and the time before each chain's first run: (by, start_time)."""
    w = Window.partitionBy(*by).orderBy("first")
    before = F.coalesce(F.sum(F.col("length") * F.col("delta")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = runs.join(first_times, by).withColumn("base", F.col("start_time") + before)
    each = at.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length"))))
    return each.select(*by, (F.col("first") + F.col("k") - 1).alias("block"), (F.col("base") + F.col("k") * F.col("delta")).alias("time"))


def interpolate(df: DataFrame, block: str, time: str, by: list[str], bucket: int = 100_000) -> DataFrame:
    """df with null times set on the line between the nearest known ones, rounded down; null outside them.

    by is followed by buckets of blocks when looking around, so that one chain is not one task: the
    last known time of each bucket is carried over from a table with a row for each bucket.
    """
    part = [*by, "_bucket"]
    own = df.withColumn("_bucket", F.floor(F.col(block) / bucket))
    known = F.when(F.col(time).isNotNull(), F.struct(F.col(block).alias("b"), F.col(time).alias("t")))
    edges = own.groupBy(*part).agg(F.max(known).alias("_last"), F.min(known).alias("_first"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    edges = edges.select(
        *part,
        F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inner = Window.partitionBy(*part).orderBy(block)
    lo = F.coalesce(F.last(known, True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    hi = F.coalesce(F.first(known, True).over(inner.rowsBetween(0, Window.unboundedFollowing)), F.col("_after"))
    out = own.join(edges, part).withColumns({"_lo": lo, "_hi": hi})
    line = F.floor(F.col("_lo.t") + (F.col(block) - F.col("_lo.b")) * (F.col("_hi.t") - F.col("_lo.t")) / (F.col("_hi.b") - F.col("_lo.b")))
    return out.withColumn(time, F.coalesce(F.col(time), line.cast(df.schema[time].dataType))).select(*df.columns)
