"""Keyed folds: events become rows of derived tables, by upsert, update, insert and delete.

A batch is first reduced by key in one aggregate that combines map-side (sums, extrema, latest by
sequence), so a hot key costs no more than others; the reduced rows then meet the stored state in one
join. Sums are algebraic (default plus the signed total), also at a key's first touch. History is by
sequence: what came before a key's last delete is gone, and an update counts only where the key was there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions import u256
from emberlog.operators import ordered as ordered_fold
from emberlog.operators.iterate import iterate
from emberlog.plans import calls, expr
from emberlog.plans.manifest import ManifestError, Operation, Set, Table
from emberlog.plans.values import compile_value, is_wide, literal, spark_type

SEQ = "evt_seq"
#: From distinct (network, target, calldata, block) to the same with `result`.
Results = Callable[[DataFrame], DataFrame]
_SIGN = {"add": 1, "increment": 1, "subtract": -1, "decrement": -1}
_NUMBER = "decimal(38,0)"
#: "the new value beats the stored one" in a condition, which makes its column a running extreme.
_BEATS = re.compile(r"^\s*\$?(\w+)\s*(>=|<=|>|<)\s*@(\w+)\s*$")


def sequence_id(block: str = "evt_block_number", tx: str = "evt_tx_index", log: str = "evt_log_index") -> Column:
    """One number that orders logs: block, transaction and log index."""
    return F.col(block).cast(_NUMBER) * 100_000_000 + F.col(tx).cast(_NUMBER) * 100_000 + F.col(log)


def _actions(table: Table) -> dict[str, str]:
    """column -> set, sum, max or min."""
    return {s.column: "sum" if s.action in _SIGN else s.action for o in table.operations for s in o.sets}


def _sum_type(table: Table, name: str) -> str:
    kind = table.column(name).type
    return _NUMBER if "int" in kind and not is_wide(kind) else spark_type(kind)


def in_order(table: Table) -> bool:
    """Whether a condition looks at the stored row otherwise than as a running extreme of a column that its operation sets."""
    looking = [o for o in table.operations if "@" in o.condition]
    plain = lambda o: (m := _BEATS.match(o.condition)) and m[3] in {s.column for s in o.sets if s.action == "set"} and o.kind == "upsert"
    return any(not plain(o) for o in looking) or bool(looking) and len(table.operations) > 1


def _called(df: DataFrame, op: Operation, results: Results | None) -> tuple[DataFrame, Operation]:
    """The view calls of an operation's texts as columns of df, and the operation over these."""
    if not any("$call" in t for t in (op.condition, *op.where.values(), *(s.value for s in op.sets))):
        return df, op
    if results is None:
        raise ManifestError("an operation calls a contract, but no results are given")
    count = 0

    def settled(text: str) -> str:
        nonlocal df, count
        n = len(calls.find_calls(text)) if "$call" in text else 0
        if n:
            df, text = calls.resolve(df, text, results, first=count)
            count += n
        return text

    over = Operation(op.kind, {k: settled(t) for k, t in op.where.items()}, settled(op.condition), tuple(Set(s.column, s.action, settled(s.value)) for s in op.sets))
    return df, over


def _operation_rows(df: DataFrame, table: Table, op: Operation, number: int, constants: Mapping | None, results: Results | None = None) -> DataFrame:
    """(network, keys, evt_seq, _op, _kind, v_<column>, h_<column>) of one operation over its events."""
    df, op = _called(df, op, results)
    find = expr.resolver(df.schema)
    network = F.col("network") if "network" in df.columns else F.lit("")
    value = lambda text, kind: compile_value(text, kind, find, constants, network)
    beats = _BEATS.match(op.condition) if "@" in op.condition else None
    ordered = in_order(table)
    beats = None if ordered else beats
    rows = df.where(expr.test(op.condition, find)) if op.condition and "@" not in op.condition else df
    cols = [ordered_fold.event_of(df, op).alias("_event")] if ordered else []
    cols += [F.col(SEQ), F.lit(number).alias("_op"), F.lit(op.kind).alias("_kind")]
    for k in table.keys:
        cols.append((network if k == "network" else value(op.where[k], table.column(k).type) if k in op.where else F.lit(None).cast(spark_type(table.column(k).type))).alias(k))
    actions = _actions(table)
    given = {s.column: s for s in op.sets}
    for name, action in actions.items():
        if name in table.keys:
            continue
        kind = _sum_type(table, name) if action == "sum" else spark_type(table.column(name).type)
        s = given.get(name)
        v = F.lit(None).cast(kind)
        if s:
            one = s.action in ("increment", "decrement") and s.value == "1"
            v = literal("1", table.column(name).type).cast(kind) if one else value(s.value, table.column(name).type).cast(kind)
            if s.action in _SIGN and _SIGN[s.action] < 0:
                v = u256.negated(v) if is_wide(table.column(name).type) else -v
        cols += [v.cast(kind).alias(f"v_{name}"), F.lit(s is not None).alias(f"h_{name}")]
    if beats:
        # The stored value moves like an extreme of the new ones; the operation's other columns follow it.
        field, sign, column = beats[1], beats[2], beats[3]
        up = find(expr.field(field))[0].cast("double") * (1 if sign[0] == ">" else -1)
        cols.append(F.struct(up.alias("by"), (F.col(SEQ).cast(_NUMBER) * (1 if len(sign) == 2 else -1)).alias("then")).alias("_rank"))
    return rows.select(*cols)


def operation_rows(events: Mapping[str, DataFrame], table: Table, constants: Mapping | None = None, results: Results | None = None) -> DataFrame:
    """All operations of a table over their events, one row for each (event, operation). results answers view calls (calls.resolve)."""
    parts, number = [], 0
    for e in table.events:
        for op in e.operations:
            if e.name in events:
                df = events[e.name]
                df = iterate(df, e.iterate) if e.iterate else df
                parts.append(_operation_rows(df, table, op, number, constants, results))
            number += 1
    if not parts:
        raise ManifestError(f"table {table.name}: none of its events is given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def by_key(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys, null being a key like others; a table without keys has one row."""
    if not keys:
        rows, other, keys = rows.withColumn("_one", F.lit(1)), other.withColumn("_one", F.lit(1)), ["_one"]
        return rows.join(other, keys, how).drop("_one")
    other = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    met = rows.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys)), how)
    if how in ("left_semi", "left_anti"):
        return met
    # A key is null where its side is not there.
    both = {k: F.coalesce(k, f"_other_{k}") for k in keys} if how == "full_outer" else {}
    return met.withColumns(both).drop(*(f"_other_{k}" for k in keys)) if both else met.drop(*(f"_other_{k}" for k in keys))


def _order(rows: DataFrame, operations: int) -> Column:
    """One number that orders (evt_seq, operation), so that aggregates over it hash."""
    if operations == 1 and isinstance(rows.schema[SEQ].dataType, T.IntegralType):
        return F.col(SEQ).cast("long")
    return (F.col(SEQ).cast("decimal(33,0)") * operations + F.col("_op")).cast(_NUMBER)


def reduce_batch(rows: DataFrame, table: Table) -> DataFrame:
    """One row for each key: what a batch does to it. Adds _born (an upsert or insert is among it), _gone (its last
    delete) and _early_seq (the last update before its first upsert).

    A hash aggregate, unless a text column is set: Spark sorts for buffers of changing length.
    """
    keys = table.keys
    rows = rows.withColumn("_at", _order(rows, max(1, len(table.operations))))
    at, seq = F.col("_at"), rows.schema[SEQ].dataType.simpleString()
    kinds = {o.kind for o in table.operations}
    actions = {n: a for n, a in _actions(table).items() if n not in keys}
    if "delete" in kinds:
        deletes = rows.where("_kind = 'delete'").groupBy(*keys).agg(F.max("_at").alias("_gone_at"), F.max(SEQ).alias("_gone"))
        rows = by_key(rows, deletes, keys).where(F.col("_gone_at").isNull() | (at > F.col("_gone_at")) | (F.col("_kind") == "delete"))
    else:
        rows = rows.withColumn("_gone", F.lit(None).cast(seq))
    live = F.col("_kind") != "delete"
    births = F.col("_kind").isin("upsert", "insert")
    if "update" in kinds:
        first = rows.groupBy(*keys).agg(F.min(F.when(births, at)).alias("_first"))
        rows = by_key(rows, first, keys)
        # Without stored state an update before the key's first upsert does nothing; with it, merge() decides.
        rows = rows.withColumn("_early", (F.col("_kind") == "update") & (F.col("_first").isNull() | (at < F.col("_first"))))
    else:
        rows = rows.withColumn("_early", F.lit(False))
    ranked = "_rank" in rows.columns
    aggs = [F.max(F.when(live, F.col(SEQ))).alias(SEQ), F.coalesce(F.max(births), F.lit(False)).alias("_born"), F.max("_gone").alias("_gone"), F.max(F.when(F.col("_early"), F.col(SEQ))).alias("_early_seq")]
    for early in (False, True) if "update" in kinds else (False,):
        p = "e_" if early else "n_"
        for name, action in actions.items():
            on = live & F.col(f"h_{name}") & (F.col("_early") == early)
            v = F.when(on, F.col(f"v_{name}"))
            if action == "set":
                order = F.struct(F.col("_rank"), at) if ranked else at
                # The value and the sequence it is of; no sequence, no value.
                aggs.append(F.max_by(f"v_{name}", F.when(on, order)).alias(p + name))
                aggs.append((F.max_by(SEQ, F.when(on, order)) if ranked else F.max(F.when(on, F.col(SEQ)))).alias(f"{p}seq_{name}"))
            elif action == "sum" and is_wide(table.column(name).type):
                aggs.append(u256.signed_sum(v).alias(p + name))
            else:
                aggs.append({"sum": F.sum, "max": F.max, "min": F.min}[action](v).alias(p + name))
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs).where(F.col(SEQ).isNotNull() | F.col("_gone").isNotNull())


def _default(table: Table, name: str) -> Column:
    c = table.column(name)
    return F.lit(None).cast(spark_type(c.type)) if c.default is None else literal(str(c.default), c.type)


def _apply(table: Table, name: str, action: str, p: str, old: Column, guard: Column | None = None) -> Column:
    """A column after the batch's sets, sums or extremes (p: n_ or e_); guard tells from its sequence whether a set counts."""
    new = F.col(p + name)
    if action == "sum":
        if is_wide(table.column(name).type):
            return u256.signed_add(old, new)
        return F.coalesce(old.cast(_sum_type(table, name)), F.lit(0)) + F.coalesce(new, F.lit(0))
    if action == "max":
        return F.greatest(old, new)
    if action == "min":
        return F.least(old, new)
    own = F.col(f"{p}seq_{name}")
    counts = own.isNotNull() if guard is None else own.isNotNull() & F.coalesce(own > guard, F.lit(True))
    return F.when(counts, new).otherwise(old)


def merge(batch: DataFrame, table: Table, state: DataFrame | None = None) -> DataFrame:
    """The stored rows after a reduced batch; state has the table's columns and evt_seq.

    Sets count where they are newer than the stored row, and so do updates as a whole; sums and
    extremes of upserts always do.
    """
    keys = table.keys
    actions = {n: a for n, a in _actions(table).items() if n not in keys}
    columns = [c.name for c in table.columns if c.name not in keys]
    updates = any(o.kind == "update" for o in table.operations)
    if state is None:
        met = batch.where("_born")
        old_seq, was = F.lit(None).cast("long"), F.lit(False)
        old = {n: F.lit(None).cast(spark_type(table.column(n).type)) for n in columns}
    else:
        stored = state.select(*keys, F.lit(True).alias("_was"), F.col(SEQ).alias("s_seq"), *(F.col(n).alias(f"s_{n}") for n in columns))
        met = by_key(stored, batch, keys, "full_outer")
        dead = F.coalesce(F.col("_gone") >= F.col("s_seq"), F.lit(False))
        was = F.coalesce(F.col("_was"), F.lit(False)) & ~dead
        met = met.withColumn("_lives", was).where(F.col("_lives") | F.col("_born"))
        was, old_seq = F.col("_lives"), F.when(F.col("_lives"), F.col("s_seq"))
        old = {n: F.when(F.col("_lives"), F.col(f"s_{n}")) for n in columns}
    out = []
    for n in columns:
        base = F.when(was, old[n]).otherwise(_default(table, n))
        if n in actions:
            if updates and state is not None:
                base = F.when(was & (F.col("_early_seq") > old_seq), _apply(table, n, actions[n], "e_", base, old_seq)).otherwise(base)
            base = _apply(table, n, actions[n], "n_", base, None if state is None else old_seq)
        out.append(base.cast(spark_type(table.column(n).type)).alias(n))
    return met.select(*keys, *out, F.greatest(old_seq, F.col(SEQ)).alias(SEQ))


def fold_rows(rows: DataFrame, table: Table, state: DataFrame | None = None) -> DataFrame:
    """The table after operation_rows()."""
    if in_order(table):
        first = rows.sparkSession.range(1).select(*(_default(table, c.name).alias(c.name) for c in table.columns)).first()
        defaults = {c.name: (spark_type(c.type), first[c.name]) for c in table.columns}
        out = ordered_fold.fold_in_order(rows, table, _actions(table), defaults, state, SEQ)
        return out.select(*table.keys, *(F.col(c.name).cast(spark_type(c.type)).alias(c.name) for c in table.columns if c.name not in table.keys), F.col(SEQ).cast(rows.schema[SEQ].dataType))
    return merge(reduce_batch(rows, table), table, state)


def fold(events: Mapping[str, DataFrame], table: Table, state: DataFrame | None = None, constants: Mapping | None = None, results: Results | None = None) -> DataFrame:
    """The table after all events of a batch. Insert-only tables are appended to, in any order."""
    rows = operation_rows(events, table, constants, results)
    if not table.insert_only:
        return fold_rows(rows, table, state)
    keys = table.keys
    cols = [F.when(F.col(f"h_{c.name}"), F.col(f"v_{c.name}")).otherwise(_default(table, c.name)).cast(spark_type(c.type)).alias(c.name) if c.name in _actions(table) and c.name not in keys else (F.col(c.name) if c.name in keys else _default(table, c.name).alias(c.name)) for c in table.columns]
    new = rows.select(*([F.col("network")] if "network" in keys else []), *cols, F.col(SEQ))
    return new if state is None else state.unionByName(new)


def latest(df: DataFrame, keys: list[str], seq: str = SEQ) -> DataFrame:
    """The row of each key with the largest sequence: what a replacing store shows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")


def grouped_by_block(df: DataFrame, block: str, seq: str, payload: list[str]) -> DataFrame:
    """One row for each block, its events in order."""
    return df.groupBy(block).agg(F.sort_array(F.collect_list(F.struct(seq, *payload))).alias("events"))


def running_deltas(blocks: DataFrame, number: str, time: str, by: list[str]) -> DataFrame:
    """Runs of equal time steps between blocks: (by, first, length, delta)."""
    w = Window.partitionBy(*by).orderBy(number)
    steps = blocks.withColumn("delta", F.col(time) - F.lag(time).over(w)).where("delta is not null")
    starts = steps.withColumn("new", F.when(F.col("delta").eqNullSafe(F.lag("delta").over(w)), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min(number).alias("first"), F.count("*").alias("length"), F.first("delta").alias("delta")).drop("run")
