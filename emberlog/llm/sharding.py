"""Histogram sort: shards of near-equal bytes, by exact splitters found on counts alone.

Rows are ordered by (hash of text, hash of id), so equal texts lie together. In each round the exact
bytes below candidate boundaries are counted across all partitions; the first round cuts the key
range into 4,096 cells, later ones only the cells in which a splitter still lies. A splitter is
settled when the bytes below a boundary are within `tolerance` of a shard of its target, or when its
cell is a single row. At most 4,096 numbers per open splitter reach the driver, at any input size.
Then rows move once, into their shard.

Near equal means: a shard's bytes are within `tolerance` of a shard of their share, unless a single row or a group of
equal texts is larger than that; then they are off by at most the row that a boundary falls into. With few
large rows the shards of a small table can so differ by the size of its largest texts.

A group of equal texts is cut only where no boundary beside it meets the tolerance. Null texts count as
empty ones of size 16; repeated rows are all placed; an empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import stored

STEP = 12
OVERHEAD = 16
#: Slots are numbered in buckets of about so many rows.
SLOT_ROWS = 20_000
# Bits of the first and second key word that each level fixes.
LEVELS = [(min(64, STEP * k), 0) for k in range(1, 7)] + [(64, min(64, STEP * k)) for k in range(1, 7)]


def _cell(word: str, bits: int) -> Column:
    return F.shiftright(word, 64 - bits) if bits else F.lit(0).cast("long")


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries (h, g), in order: a row is right of one if its (h, g) is not below it. keys: h, g, size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    # Of each open splitter: its number -> (cell of the level before, bytes below that cell).
    open_ = {i: (None, 0) for i in range(1, shards)}
    settled: dict[int, tuple[int, int]] = {}
    before = (0, 0)
    for level in LEVELS:
        if not open_ or not total:
            break
        cells = keys.withColumn("a", _cell("h", before[0])).withColumn("b", _cell("g", before[1]))
        if before != (0, 0):
            wanted = F.lit(False)
            for a, b in sorted({c for c, _ in open_.values()}):
                wanted = wanted | ((F.col("a") == a) & (F.col("b") == b))
            cells = cells.where(wanted)
        counts = cells.groupBy("a", "b", _cell("h", level[0]).alias("x"), _cell("g", level[1]).alias("y")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        inside: dict[tuple | None, list] = {}
        for r in sorted(counts, key=lambda r: (r["x"], r["y"])):
            inside.setdefault((r["a"], r["b"]) if before != (0, 0) else None, []).append(r)
        still = {}
        for i, (cell, below) in open_.items():
            target = total * i / shards
            for r in inside[cell]:
                if below + r["bytes"] >= target:
                    break
                below += r["bytes"]
            start, end = (r["x"], r["y"]), below + r["bytes"]
            near = below if target - below <= end - target else end
            if abs(near - target) <= slack or r["n"] == 1 or level == LEVELS[-1]:
                settled[i] = _bound(start, level, after=near == end)
            else:
                still[i] = (start, below)
        open_, before = still, level
    return [settled[i] for i in sorted(settled)]


def _bound(cell: tuple[int, int], level: tuple[int, int], after: bool) -> tuple[int, int]:
    """The smallest key of a cell, or the smallest beyond it; Python integers, so 2^63 may stand for 'none beyond'."""
    low = -(1 << 63)
    if level[1]:
        g = (cell[1] + after) << (64 - level[1])
        return (cell[0] + 1, low) if g >= 1 << 63 else (cell[0], g)
    return (cell[0] + after) << (64 - level[0]), low


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keys = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", (F.octet_length("t") + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32("t").alias("text_crc32"), F.xxhash64("t").alias("h"), F.xxhash64("id").alias("g")
    )
    keys = stored(keys, "shard-keys")
    shard = F.lit(0)
    for h, g in find_splitters(keys.select("h", "g", "size"), shards, tolerance):
        if h < 1 << 63:
            shard = shard + F.when((F.col("h") > h) | ((F.col("h") == h) & (F.col("g") >= g)), 1).otherwise(0)
    rows = keys.count()
    buckets = max(1, -(-rows // (shards * SLOT_ROWS)))
    dealt = keys.withColumn("shard", shard).withColumn("bucket", F.pmod("g", F.lit(buckets)))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    k = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "g", "id"))
    placed = dealt.withColumn("k", k).join(before, ["shard", "bucket"])
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"))
