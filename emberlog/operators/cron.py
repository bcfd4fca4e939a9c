"""Values sampled at fixed block intervals, live or over history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticks(ranges: DataFrame, every: int, start: str = "start", end: str = "end", last_done: str | None = None) -> DataFrame:
    """ranges with one row for each sampled block from start to end; with last_done, only those after it."""
    rows = ranges.where(F.col(start) <= F.col(end)).withColumn("tick", F.explode(F.sequence(F.col(start).cast("long"), F.col(end).cast("long"), F.lit(every).cast("long"))))
    return rows if last_done is None else rows.where(F.col(last_done).isNull() | (F.col("tick") > F.col(last_done)))


def alive(rows: DataFrame, born: DataFrame, key: str) -> DataFrame:
    """Ticks of addresses from their birth block on."""
    return rows.join(born, key).where(F.col("tick") >= F.col("birth")).drop("birth")


def sampled(values: DataFrame, key: list[str], at: str, every: int, end: int | None, chunk: int = 4096) -> DataFrame:
    """(key, tick, value): the latest of values (key, at, value) at every tick (0, every, …) up to end, from each key's first row on.

    The same as alive() and as_of() over ticks(), but ticks are made last and are never shuffled, sorted or joined: rows are
    thinned out to one for each key and tick that follows them, a value holds until the next such tick, and the ticks
    between are spread out on the way to the output, at most chunk at a time. A null value leaves the one before it; a null
    key has ticks but no values, as an equality join would have it.
    """
    from pyspark.sql import Window

    named = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    below = F.col(at) - F.pmod(F.col(at), F.lit(every))
    tick = F.greatest(F.when(below == F.col(at), below).otherwise(below + every), F.lit(0)).cast("long")
    seen = values.where(F.col(at) <= F.lit(end).cast("long")).select(*key, tick.alias("_from"), at, F.when(named, F.col("value")).alias("value"))
    steps = seen.where(F.col("_from") <= F.lit(end).cast("long")).groupBy(*key, "_from").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col(at))).alias("_v"))
    order = Window.partitionBy(*key).orderBy("_from")
    until = F.coalesce(F.lead("_from").over(order) - every, F.lit(end).cast("long"))
    held = steps.select(*key, "_from", until.alias("_until"), F.last("_v", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("value"))
    chunks = held.withColumn("_first", F.explode(F.sequence("_from", "_until", F.lit(every * chunk).cast("long"))))
    last = F.least(F.col("_first") + every * (chunk - 1), F.col("_until"))
    return chunks.select(*key, F.explode(F.sequence("_first", last, F.lit(every).cast("long"))).alias("tick"), "value")


def as_of(rows: DataFrame, values: DataFrame, key: list[str], at: str, bucket: int) -> DataFrame:
    """rows with the latest of values (key, at, value) at or before their tick.

    An as-of join without a range join: both sides go to buckets of blocks, the last value of each
    earlier bucket is carried over from a table with a row for each key and bucket, and inside a
    bucket the last known value is taken in order. No key's whole history meets in one task.
    """
    from pyspark.sql import Window

    left = rows.select(*rows.columns, F.floor(F.col("tick") / bucket).alias("_b"), F.col("tick").alias("_at"), F.lit(None).cast(values.schema["value"].dataType).alias("_v"), F.lit(True).alias("_asks"))
    right = values.select(*key, F.floor(F.col(at) / bucket).alias("_b"), F.col(at).alias("_at"), F.col("value").alias("_v"), F.lit(False).alias("_asks"))
    both = left.unionByName(right, allowMissingColumns=True)
    ends = both.groupBy(*key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", True).over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    inner = Window.partitionBy(*key, "_b").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_here", F.last("_v", True).over(inner)).where("_asks").join(carried, [*key, "_b"], "left")
    return met.select(*rows.columns, F.coalesce("_here", "_carry").alias("value"))


def synthetic(rows: DataFrame) -> DataFrame:
    """Ticks as events: zero hashes, no log and transaction index."""
    zero = F.lit("0x" + "0" * 64)
    return rows.withColumns({"evt_block_number": F.col("tick"), "evt_tx_hash": zero, "evt_block_hash": zero, "evt_tx_index": F.lit(0), "evt_log_index": F.lit(0)})
