"""Messages for sinks: event JSON, chat templates, routing, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.plans import expr

CHUNK_BYTES = 75_000


def event_json(df: DataFrame, name: str, payload: list[str], meta: list[str]) -> DataFrame:
    """(…meta, message): event data and transaction information as JSON, names kept."""
    body = F.to_json(F.struct(F.lit(name).alias("event_name"), F.struct(*payload).alias("event_data"), F.struct(*meta).alias("transaction")))
    return df.withColumn("message", body)


def value_json(c: Column, index_keys: list[str] | None = None) -> Column:
    """Compatible JSON of a struct: keys 0, 1, … in order where index_keys names its fields."""
    return F.to_json(F.struct(*(c[f].alias(str(k)) for k, f in enumerate(index_keys)))) if index_keys else F.to_json(c)


def raw_text(c: Column) -> Column:
    """An array as [a, b]."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))


def chat(text: str, df: DataFrame) -> Column:
    """A {{path}} template; {{format_value(x, d)}} shifts the decimal point. Unknown paths stay as they are."""
    find = expr.resolver(df.schema)
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(?:format_value\(\s*([\w.\[\]]+)\s*,\s*(\d+)\s*\)|([\w.\[\]]+))\s*\}\}", text):
        parts.append(F.lit(text[at : m.start()]))
        at = m.end()
        try:
            c = find(expr.field(m[1] or m[3]))[0]
        except expr.ExprError:
            parts.append(F.lit(m[0]))
            continue
        parts.append(format_value(c, int(m[2])) if m[1] else F.regexp_replace(c.cast("string"), '"', ""))
    return F.concat(*parts, F.lit(text[at:]))


def format_value(c: Column, digits: int, padded: bool = True) -> Column:
    """A whole number as decimal text with `digits` places, trailing zeros gone; padded=False leaves the fraction's leading zeros out."""
    whole = c.cast("decimal(38,0)")
    unit = F.lit(10**digits).cast("decimal(38,0)")
    rest = F.try_mod(whole, unit)
    head = F.try_divide(whole - rest, unit).cast("decimal(38,0)").cast("string")
    tail = F.lpad(rest.cast("string"), digits, "0") if padded else rest.cast("string")
    return F.when(rest == 0, head).otherwise(F.concat(head, F.lit("."), F.regexp_replace(tail, "0+$", "")))


def routed(df: DataFrame, events: list[dict], event: str = "event_name", network: str = "network") -> DataFrame:
    """Rows that a sink's configuration takes: event, networks, and a filter or legacy conditions (the filter wins)."""
    find, known = expr.resolver(df.schema), set(df.columns)
    out = None
    for e in events:
        on = F.col(event) == e["event_name"]
        if e.get("networks"):
            on = on & F.col(network).isin(e["networks"])
        if e.get("filter_expression"):
            on = on & expr.test(e["filter_expression"], find)
        elif e.get("conditions"):
            on = on & expr.legacy(e["conditions"], find, known)
        part = df.where(on).withColumn("alias", F.lit(e.get("alias", e["event_name"])))
        out = part if out is None else out.unionAll(part)
    return out


def message_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("-", *parts), 256)


def chunks(df: DataFrame, by: list[str], order: list[str], size: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """df with `chunk`, the number of the message each row goes into: rows of one `by` in order, a message being
    closed before the row that would take it beyond limit bytes. A row larger than the limit has one of its own.

    The rows of one `by` are read in order by one task, batch by batch; only the open message's size is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, used = None, 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            keys = list(pdf[by].itertuples(index=False, name=None))
            out = []
            for own, n in zip(keys, pdf[size].tolist(), strict=True):
                if own != key:
                    key, number, used = own, 0, 0
                elif used and used + n > limit:
                    number, used = number + 1, 0
                used += n
                out.append(number)
            pdf["chunk"] = out
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, f"{kinds}, chunk long")


def narrow_enough(first: int, last: int, most: int = 10) -> bool:
    """Chat sinks only get ranges of few blocks."""
    return last - first <= most


def network_distance(setups: list[tuple[str, int]]) -> dict[str, int]:
    """The finality distance of each network: the largest of all that touch it."""
    out: dict[str, int] = {}
    for network, distance in setups:
        out[network] = max(distance, out.get(network, 0))
    return out


# Blocks to stay behind the head, by chain id.
SAFE_DISTANCE = {1: 20, 10: 24, 56: 24, 100: 24, 137: 200, 8453: 24, 42161: 24, 43114: 12}
SAFE_DISTANCE_ELSE = 64


def safe_distance(chain_id: int) -> int:
    return SAFE_DISTANCE.get(chain_id, SAFE_DISTANCE_ELSE)
