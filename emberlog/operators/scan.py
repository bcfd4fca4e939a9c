"""Scans of logs: block ranges, addresses, topics, factories, native transfers and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.keccak import keccak256

#: Address lists beyond this are joined instead of written into the filter.
MAX_LITERALS = 1000


def topic_of(literal: str | int | bool) -> str:
    """The 32-byte word a topic literal stands for: true/false, an address, a number, or the hash of other text."""
    text = str(literal).lower() if isinstance(literal, bool) else str(literal)
    if text in ("true", "false"):
        return f"0x{int(text == 'true'):064x}"
    if text.startswith("0x"):
        return "0x" + text[2:].lower().rjust(64, "0")
    if text.isdigit():
        return f"0x{int(text):064x}"
    return "0x" + keccak256(text.encode()).hex()


def block_range(df: DataFrame, block: str, start: int | None, end: int | None, head: int | None = None, distance: int = 0) -> DataFrame:
    """Blocks from start to end, and no closer to the head than distance. The bounds reach the file scan."""
    if head is not None:
        end = head - distance if end is None else min(end, head - distance)
    if start is not None:
        df = df.where(F.col(block) >= start)
    return df if end is None else df.where(F.col(block) <= end)


def resume_start(last_synced: int | None, start: int | None, head: int) -> int:
    """Where a scan begins: after the checkpoint if a start was given, at the start, else at the head."""
    if start is None:
        return head
    if start > head:
        raise ValueError(f"start {start} is beyond the head {head}")
    return start if last_synced is None else max(start, last_synced + 1)


def addresses(df: DataFrame, column: str, wanted: list[str] | DataFrame | None) -> DataFrame:
    """Rows of the wanted addresses: None is any, an empty list none; a DataFrame (its first column) is semi-joined."""
    if wanted is None:
        return df
    if isinstance(wanted, DataFrame):
        keys = wanted.select(F.lower(F.col(wanted.columns[0])).alias("_address")).distinct()
        return df.join(keys, F.lower(F.col(column)) == F.col("_address"), "left_semi")
    if len(wanted) > MAX_LITERALS:
        spark = df.sparkSession
        return addresses(df, column, spark.createDataFrame([(a,) for a in wanted], "a string"))
    return df.where(F.lower(F.col(column)).isin([a.lower() for a in wanted])) if wanted else df.where(F.lit(False))


def topics(df: DataFrame, wanted: list[list | None], column: str = "topics") -> DataFrame:
    """Rows whose topics are, place by place, among the wanted; None leaves a place open."""
    for k, options in enumerate(wanted):
        if options is not None:
            df = df.where(F.coalesce(F.try_element_at(column, F.lit(k + 1)).isin([topic_of(o) for o in options]), F.lit(False)))
    return df


def may_contain(bloom: bytes, item: bytes) -> bool:
    """Whether a block's 2048-bit logs bloom has all three bits of an address or topic."""
    h = keccak256(item)
    bits = int.from_bytes(bloom, "big")
    return all(bits >> (int.from_bytes(h[k : k + 2], "big") & 2047) & 1 for k in (0, 2, 4))


def factory_addresses(events: DataFrame, inputs: list[str], factory: str = "address") -> DataFrame:
    """(factory, address) of every contract that creation events name."""
    named = F.explode(F.array(*(F.lower(F.col(c)) for c in inputs)))
    return events.select(F.col(factory).alias("factory"), named.alias("address")).where("address is not null").distinct()


def births(events: DataFrame, key: str, block: str) -> DataFrame:
    """(key, birth): the first block in which each address was named."""
    return events.groupBy(key).agg(F.min(block).alias("birth"))


def since_birth(df: DataFrame, key: str, block: str, born: DataFrame) -> DataFrame:
    """Rows of known addresses from their birth block on."""
    return df.join(born, key).where(F.col(block) >= F.col("birth"))


def native_transfers(blocks: DataFrame) -> DataFrame:
    """Plain value transfers of blocks (…, transactions array<struct<from,to,value,input,hash>>)."""
    tx = blocks.withColumn("t", F.explode("transactions")).select(*[c for c in blocks.columns if c != "transactions"], "t.*")
    bare = F.coalesce(F.col("input"), F.lit("0x")).isin("", "0x")
    return tx.where(F.col("to").isNotNull() & bare & ~F.coalesce(F.col("value").cast("string"), F.lit("0")).rlike("^(0x)?0*$"))


def traces(df: DataFrame, kinds: tuple[str, ...] = ("call",)) -> DataFrame:
    """Value-carrying traces (type, from, to, value), in the shape of native transfers."""
    return df.where(F.col("type").isin(*kinds) & F.col("to").isNotNull() & ~F.col("value").cast("string").rlike("^(0x)?0*$"))


def lookup_blocks(blocks: DataFrame, wanted: DataFrame, number: str = "block_number") -> DataFrame:
    """Block headers of the numbers in wanted, each once."""
    return blocks.join(wanted.select(number).distinct(), number, "left_semi")


def lookup_receipts(receipts: DataFrame, hashes: DataFrame, tx_hash: str = "tx_hash") -> DataFrame:
    return receipts.join(hashes.select(tx_hash).distinct(), tx_hash, "left_semi")


def only_events(df: DataFrame, column: str, include: list[str] | None) -> DataFrame:
    """The raw events to store: those listed; without a list none."""
    return df.where(F.col(column).isin(include)) if include else df.where(F.lit(False))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns as columns with prefixed snake-case names, at any depth; arrays of structs become JSON."""
    from pyspark.sql import types as T

    from emberlog.functions.names import snake

    def walk(c: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in walk(c[f.name], f.dataType, f"{name}{sep}{snake(f.name)}")]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return [F.to_json(c).alias(name)]
        return [c.alias(name)]

    return df.select(*(x for f in df.schema for x in walk(F.col(f"`{f.name}`"), f.dataType, snake(f.name))))
