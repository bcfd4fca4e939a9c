"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A sequence is filled greedily, largest piece that fits first. If a gap is left, its smallest piece
(but the first) is replaced by two unpacked pieces whose sum fits the gap that this opens more
tightly. Which pieces have equal lengths does not matter to that rule, so it runs over the histogram
of lengths: at most `capacity` numbers, whatever the size of the corpus. One step fixes a pattern of
lengths and repeats it as often as the histogram allows, exactly as the rule would sequence by
sequence. Pieces then find their place by rank among the pieces of their length.

Null and empty texts have no ids and so form a piece of the end token alone; repeated rows are
packed each for itself (pieces carry a row number besides the id); an empty table gives no rows.
Ids may be of any type or null; other columns of docs, of whatever names, are not read. Only documents longer
than the capacity are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.bpe import loaded
from emberlog.llm.common import stored

CAPACITY = 4096
END_ID = 1
#: Pieces of one length are ranked in buckets of about so many rows.
RANK_ROWS = 20_000


def plan_patterns(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Packs counts[n] pieces of length n for each n; returns (times, {length: pieces}) in order.

    counts has capacity + 1 entries, the first unused. The last unpacked length, the greedy fill and
    the swap depend on which lengths are left; so a pattern holds until one of its lengths runs out.
    """
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    out = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        items: dict[int, int] = {}
        gap = capacity
        first = int(there[-1])
        while gap and len(fit := there[: np.searchsorted(there, gap, side="right")]):
            n = int(fit[-1])
            free = left[n] - items.get(n, 0)
            if free <= 0:
                there = there[there != n]
                continue
            k = min(int(free), gap // n) if items else 1
            items[n] = items.get(n, 0) + k
            gap -= k * n
        if gap and sum(items.values()) > 1:
            smallest = min(items)
            if smallest != first or items[smallest] > 1:
                room = gap + smallest
                pair = _two(left, items, room, smallest)
                if pair:
                    items[smallest] -= 1
                    for n in pair:
                        items[n] = items.get(n, 0) + 1
                    items = {n: k for n, k in items.items() if k}
        times = int(min(left[n] // k for n, k in items.items()))
        for n, k in items.items():
            left[n] -= times * k
        out.append((times, items))


def _two(left: np.ndarray, items: dict[int, int], room: int, smallest: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum in (smallest, room], beyond those already in items."""
    free = left[: room + 1].copy()
    for n, k in items.items():
        if n <= room:
            free[n] -= k
    small = np.flatnonzero(free[:room] > 0)
    if not len(small):
        return None
    at = np.searchsorted(small, room - small, side="right") - 1
    ok = at >= 0
    a, b = small[ok], small[at[ok]]
    same = a == b
    lone = same & (free[a] < 2)
    # a lone length cannot pair with itself: the next smaller one stands in
    lower = at[ok] - 1
    b = np.where(lone & (lower >= 0), small[np.maximum(lower, 0)], b)
    good = ~(lone & (lower < 0)) & (a + b <= room) & (a + b > smallest)
    if not good.any():
        return None
    k = int(np.argmax(np.where(good, a + b, -1)))
    return int(a[k]), int(b[k])


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where the ranks of each length go: from rank `first` of `length` on, `times` sequences from `sequence` on take them in turn, at `offset` plus whole lengths."""
    rows, used, sequence = [], {}, 0
    for times, items in patterns:
        offset = 0
        for n, k in sorted(items.items(), reverse=True):
            rows.append((n, used.get(n, 0), times, sequence, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "times", "sequence", "offset"), cols, strict=True))


def tokenised_pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids and end token. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary)
        for pdf in batches:
            rows = []
            for doc, ids in zip(pdf["id"].tolist(), bpe.encode_batch(pdf["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    # As text, since pandas holds a column of numbers with a null in doubles.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, piece int, start long, length long, ids_crc32 long")
    return rows.withColumn("id", F.col("id").cast(kind))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to capacity and the columns of tokenised_pieces().

    Ranks within a length come from counts per (length, bucket) plus a row number inside the bucket.
    Buckets are hashes of the row, and there are more of them the more rows there are, so a length
    that a third of all pieces share spreads over all tasks.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    total = sum(r["count"] for r in counts)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    slots = spark.sparkContext.broadcast(_slots(plan_patterns(histogram)))
    buckets = max(1, -(-total // RANK_ROWS))
    # Repeated rows are alike in every column; any order among them gives the same result.
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")))
    kind = pieces.schema["id"].dataType.simpleString()
    ranked = ranked.withColumn("id", F.col("id").cast("string")).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("k") - 1).drop("bucket", "k", "before")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = slots.value
        wide = np.int64(1) << 40
        key = s["length"] * wide + s["first"]
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(np.int64), pdf.pop("rank").to_numpy(np.int64)
            i = np.searchsorted(key, n * wide + rank, side="right") - 1
            turn = rank - s["first"][i]
            pdf["sequence_id"] = s["sequence"][i] + turn % s["times"][i]
            pdf["offset"] = s["offset"][i] + turn // s["times"][i] * n
            yield pdf

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long").withColumn("id", F.col("id").cast(kind))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    The pieces, a few numbers each, are written to the shared folder once, as their histogram is
    needed before they can be placed; texts are tokenised once and never shuffled.
    """
    pieces = stored(tokenised_pieces(docs, vocabulary, id_col, text_col, capacity), "pieces")
    out = pack(pieces, capacity).withColumnRenamed("id", id_col)
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
