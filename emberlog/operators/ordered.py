"""Folds whose conditions look at the stored row (@column) in ways that no aggregate expresses.

Such a fold is sequential for each key. Rows are sorted by key and sequence and read in batches; a task holds
the one row that it is folding, so a key of any number of events costs time but no memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from emberlog.plans import expr
from emberlog.plans.manifest import Operation, Table
from emberlog.plans.values import is_wide


def _event_json(df: DataFrame, trees: list) -> Column:
    """The event's fields that conditions need, as JSON."""
    names = sorted({str(f.path[0]) for t in trees for f in expr.fields(t) if not f.table})
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise expr.ExprError(f"no field {missing[0]!r}")
    return F.to_json(F.struct(*(F.col(f"`{n}`") for n in names))) if names else F.lit("{}")


def event_of(df: DataFrame, op: Operation) -> Column:
    """What the condition of op needs of the event, as JSON; null if it does not look at the stored row."""
    return _event_json(df, [expr.parse(op.condition)]) if "@" in op.condition else F.lit(None).cast("string")


def _number(v):
    """A stored or given value for arithmetic: text of 256-bit numbers as an int."""
    if isinstance(v, str):
        return -int(v[1:], 16) if v.startswith("-") else int(v, 16)
    return int(v) if isinstance(v, Decimal) and v == v.to_integral_value() else v


def _text(v: int) -> str:
    return f"{'-' if v < 0 else ''}0x{abs(v):064x}"


def fold_in_order(rows: DataFrame, table: Table, kinds: Mapping[str, str], defaults: Mapping, state: DataFrame | None, seq: str) -> DataFrame:
    """The table after rows (keys, seq, _op, _kind, v_<column>, h_<column>, _event), event by event.

    kinds: column -> set, sum, max or min. Without a stored row an upsert applies whatever its condition says, an update
    and a delete do not. Against a row that the state holds, what is not newer sets nothing and updates nothing.
    """
    keys = table.keys
    columns = [c.name for c in table.columns if c.name not in keys]
    set_by = [n for n in columns if n in kinds]
    given = rows.select(*keys, F.col(seq).cast("decimal(38,0)").alias(seq), F.col("_op").cast("int").alias("_op"), "_kind", "_event", *(F.col(f"v_{n}") for n in set_by), *(F.col(f"h_{n}") for n in set_by), *(F.lit(None).cast(rows.schema[f"v_{n}"].dataType if n in set_by else defaults[n][0]).alias(f"s_{n}") for n in columns))
    if state is not None:
        old = state.select(
            *keys, F.col(seq).cast("decimal(38,0)").alias(seq), F.lit(-1).alias("_op"), F.lit("state").alias("_kind"), F.lit(None).cast("string").alias("_event"),
            *(F.lit(None).cast(given.schema[f"v_{n}"].dataType).alias(f"v_{n}") for n in set_by), *(F.lit(False).alias(f"h_{n}") for n in set_by),
            *(F.col(n).cast(given.schema[f"s_{n}"].dataType).alias(f"s_{n}") for n in columns),
        )
        given = given.unionByName(old)
    operations = table.operations
    trees = [expr.parse(o.condition) if "@" in o.condition else None for o in operations]
    wide = {n for n in columns if is_wide(table.column(n).type)}
    blank = {n: defaults[n][1] for n in columns}
    out_schema = T.StructType([*(T.StructField(k, given.schema[k].dataType) for k in keys), *(T.StructField(n, given.schema[f"s_{n}"].dataType) for n in columns), T.StructField(seq, T.DecimalType(38, 0))])
    arrow = to_arrow_schema(out_schema)

    def apply(row: dict | None, r: dict, stored_at) -> dict | None:
        kind, at = r["_kind"], r[seq]
        if kind == "state":
            return {n: r[f"s_{n}"] for n in columns} | {seq: at}
        tree = trees[r["_op"]]
        stale = stored_at is not None and row is not None and at <= stored_at
        if row is None and kind in ("update", "delete"):
            return None
        if row is not None and tree is not None:
            event = json.loads(r["_event"], parse_float=Decimal)
            if not expr.holds(tree, event, {n: int(v) if isinstance(v, Decimal) and v == v.to_integral_value() else v for n, v in row.items()}):
                return row
        if kind == "delete":
            return row if stored_at is not None and at < stored_at else None
        if kind == "update" and stale:
            return row
        row = dict(blank) | {seq: at} if row is None else row
        for n in set_by:
            if not r[f"h_{n}"]:
                continue
            v, was = r[f"v_{n}"], row[n]
            if kinds[n] == "set":
                row[n] = was if stale else v
            elif v is not None:
                v, was = (None if x is None else _number(x) for x in (v, was))
                new = (was or 0) + v if kinds[n] == "sum" else v if was is None else (max if kinds[n] == "max" else min)(was, v)
                row[n] = _text(new) if n in wide else new
        row[seq] = max(row[seq], at)
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, stored_at, done = None, None, None, []

        def shown() -> dict:
            return dict(zip(keys, key, strict=True)) | row

        for batch in batches:
            for r in batch.to_pylist():
                own = tuple(r[k] for k in keys)
                if own != key:
                    if row is not None:
                        done.append(shown())
                    key, row, stored_at = own, None, None
                if r["_kind"] == "state":
                    stored_at = r[seq]
                row = apply(row, r, stored_at)
                stored_at = stored_at if row is not None else None
            if done:
                yield _batch(done, arrow)
                done = []
        if row is not None:
            yield _batch([shown()], arrow)

    order = [*keys, F.col("_kind") != "state", seq, "_op"]
    dealt = given.repartition(*keys) if keys else given.repartition(1)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, out_schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows in the schema's types: whole numbers that came as decimals or ints go where they belong."""
    cast = lambda v, t: Decimal(int(v)) if v is not None and pa.types.is_decimal(t) else int(v) if isinstance(v, Decimal) and pa.types.is_integer(t) else v
    return pa.RecordBatch.from_arrays([pa.array([cast(r[f.name], f.type) for r in rows], f.type) for f in schema], schema=schema)

