"""The declarative program: tables derived from events, read from YAML or dicts, checked before a plan is built."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import yaml

from emberlog.plans import expr
from emberlog.plans.values import TYPES, spark_type
from emberlog.sources import abi

ACTIONS = ("set", "add", "subtract", "max", "min", "increment", "decrement")
KINDS = ("upsert", "update", "insert", "delete")
#: Injected columns and their types.
METADATA = {
    "evt_block_number": "uint64", "evt_tx_index": "uint64", "evt_log_index": "uint64", "evt_tx_hash": "bytes32",
    "evt_block_hash": "bytes32", "evt_contract_address": "address", "evt_block_timestamp": "timestamp",
}
#: Metadata that tables get, and the names of the columns.
INJECTED = {"evt_block_number": "block_number", "evt_block_timestamp": "block_timestamp", "evt_tx_hash": "tx_hash", "evt_block_hash": "block_hash", "evt_contract_address": "contract_address"}
_INTERVAL = {"s": 1, "m": 60, "h": 3600, "d": 86400}


class ManifestError(ValueError):
    """A program that cannot be run as written."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str = ""
    default: Any = None
    nullable: bool = False


@dataclass(frozen=True)
class Set:
    column: str
    action: str = "set"
    value: str = "1"


@dataclass(frozen=True)
class Operation:
    kind: str
    where: Mapping[str, str] = field(default_factory=dict)
    condition: str = ""
    sets: tuple[Set, ...] = ()


@dataclass(frozen=True)
class Event:
    name: str
    operations: tuple[Operation, ...]
    iterate: tuple[tuple[str, str], ...] = ()  # (array path, alias)


@dataclass(frozen=True)
class Cron:
    """Operations by time: they are those of the event of this name."""

    event: str
    due: str  # an interval or a cron expression
    network: str | None = None  # None: all
    start: int | None = None  # blocks that are sampled before the live ticks
    end: int | None = None
    every: int = 1


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    events: tuple[Event, ...]
    is_global: bool = False
    cross_network: bool = False
    timestamp: bool = False
    crons: tuple[Cron, ...] = ()

    @property
    def operations(self) -> list[Operation]:
        return [o for e in self.events for o in e.operations]

    @property
    def insert_only(self) -> bool:
        return all(o.kind == "insert" for o in self.operations)

    @property
    def keys(self) -> list[str]:
        """The network, unless the table spans them, and all columns of where."""
        own = list(dict.fromkeys(k for o in self.operations for k in o.where))
        return ([] if self.cross_network else ["network"]) + ([] if self.is_global else own)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise ManifestError(f"table {self.name}: no column {name!r}")


def interval_seconds(text: str) -> int:
    """The seconds of 30s, 5m, 1h or 1d."""
    m = re.fullmatch(r"(\d+)([smhd])", text)
    if not m or not int(m[1]):
        raise ManifestError(f"no interval: {text!r}")
    return int(m[1]) * _INTERVAL[m[2]]


def parse_iterate(text: str) -> tuple[str, str]:
    m = re.fullmatch(r"\s*\$([\w.\[\]]+)\s+as\s+(\w+)\s*", text)
    if not m:
        raise ManifestError(f"no iteration: {text!r}")
    return m[1], m[2]


def infer_type(value: str, fields: Mapping[str, str], default: Any = None) -> str:
    """The type of a column from the value it is given: fields has the types of the event's fields."""
    text = str(value).strip()
    bare = text.lstrip("$")
    if text.startswith("$if("):
        return "string"
    if bare in METADATA:
        return METADATA[bare]
    if text.startswith("$") and re.split(r"[.\[]", bare)[0] in fields and re.fullmatch(r"\$[\w.\[\]]+", text):
        return fields[re.split(r"[.\[]", bare)[0]]
    if "$" in text and re.search(r"[-+*/^]", text):
        return "uint256"
    text = str(default if default is not None and "$" in text else text)
    if re.fullmatch(r"-?\d+", text):
        return "uint256"
    if text.lower() in ("true", "false"):
        return "bool"
    if re.fullmatch(r"0x[0-9a-fA-F]{40}", text):
        return "address"
    if "$" in text:
        raise ManifestError(f"no type can be inferred from {value!r}")
    return "string"


def table(spec: Mapping, fields: Mapping[str, Mapping[str, str]] | None = None) -> Table:
    """A Table from its dict form, with types inferred from fields: {event: {field: type}}."""
    fields = fields or {}
    events, crons = [], []
    for k, c in enumerate(spec.get("cron") or []):
        if bool(c.get("interval")) == bool(c.get("schedule")):
            raise ManifestError(f"table {spec['name']}: a cron needs an interval or a schedule")
        block = lambda name: None if c.get(name) is None else int(c[name])  # noqa: B023, E731
        crons.append(Cron(f"cron_{k}", c.get("interval") or c["schedule"], c.get("network"), block("start_block"), block("end_block"), block("block_interval") or 1))
    given = [*(spec.get("events") or []), *({"event": c.event, "operations": s["operations"]} for c, s in zip(crons, spec.get("cron") or [], strict=True))]
    for e in given:
        ops = []
        for o in e.get("operations", e.get("table", [])):
            sets = tuple(Set(s["column"], s.get("action", "set"), str(s.get("value", "1"))) for s in o.get("set", []))
            ops.append(Operation(o["type"], dict(o.get("where", {})), str(o.get("if", o.get("filter", "")) or ""), sets))
        events.append(Event(e["event"], tuple(ops), tuple(parse_iterate(i) for i in e.get("iterate", []))))
    columns = []
    for c in spec["columns"]:
        kind = c.get("type", "")
        if not kind:
            uses = [(e.name, v) for e in events for o in e.operations for k, v in [*o.where.items(), *((s.column, s.value) for s in o.sets)] if k == c["name"]]
            if not uses:
                raise ManifestError(f"table {spec['name']}: column {c['name']!r} has no type and no value")
            kind = infer_type(uses[0][1], fields.get(uses[0][0], {}), c.get("default"))
        columns.append(Column(c["name"], kind, c.get("default"), bool(c.get("nullable"))))
    out = Table(spec["name"], tuple(columns), tuple(events), bool(spec.get("global")), bool(spec.get("cross_chain", spec.get("cross_network"))), bool(spec.get("timestamp")), tuple(crons))
    out = with_metadata(out) if spec.get("metadata") else out
    check(out)
    return out


def with_metadata(t: Table) -> Table:
    """t with the injected columns that it does not declare itself, set by every event that touches a row: the latest by sequence."""
    have = {c.name for c in t.columns}
    wanted = {INJECTED[k]: k for k in INJECTED if INJECTED[k] not in have and (t.timestamp or k != "evt_block_timestamp")}
    columns = tuple(Column(name, METADATA[k], nullable=True) for name, k in wanted.items())
    sets = tuple(Set(name, "set", f"${k}") for name, k in wanted.items())
    events = tuple(Event(e.name, tuple(o if o.kind == "delete" else replace(o, sets=o.sets + sets) for o in e.operations), e.iterate) for e in t.events)
    return replace(t, columns=t.columns + columns, events=events)


def check(t: Table) -> None:
    """Raises on a table that could not be folded as meant."""
    names = [c.name for c in t.columns]
    if len(names) != len(set(names)):
        raise ManifestError(f"table {t.name}: a column is there twice")
    actions: dict[str, set[str]] = {}
    for c in t.columns:
        if c.type not in TYPES:
            spark_type(c.type)
    wheres = {tuple(sorted(o.where)) for o in t.operations if o.kind != "insert"}
    if not t.is_global and len(wheres) > 1 and not any(o.kind == "delete" for o in t.operations):
        raise ManifestError(f"table {t.name}: operations have unlike where columns")
    for o in t.operations:
        if o.kind not in KINDS:
            raise ManifestError(f"table {t.name}: no operation {o.kind!r}")
        if o.kind in ("upsert", "update", "delete") and not o.where and not t.is_global:
            raise ManifestError(f"table {t.name}: {o.kind} needs where")
        for s in o.sets:
            c = t.column(s.column)
            if s.action not in ACTIONS:
                raise ManifestError(f"table {t.name}: no action {s.action!r}")
            if s.value == "$null" and not c.nullable:
                raise ManifestError(f"table {t.name}: {s.column} is not nullable")
            actions.setdefault(s.column, set()).add({"subtract": "add", "increment": "add", "decrement": "add"}.get(s.action, s.action))
        for k in o.where:
            t.column(k)
        if o.kind == "insert":
            given = {s.column for s in o.sets} | set(o.where)
            for c in t.columns:
                if c.name not in given and c.default is None and not c.nullable:
                    raise ManifestError(f"table {t.name}: insert leaves {c.name} open")
        if o.condition:
            expr.parse(o.condition)
    for name, own in actions.items():
        if len(own) > 1:
            raise ManifestError(f"table {t.name}: {name} mixes {sorted(own)}")


def load(text: str) -> dict:
    """A whole program from YAML, ${NAME} and ${NAME:-default} being taken from the environment."""

    def env(m: re.Match) -> str:
        value = os.environ.get(m[1], m[3])
        if value is None:
            raise ManifestError(f"environment variable {m[1]} is not set")
        return value

    spec = yaml.safe_load(re.sub(r"\$\{(\w+)(:-([^}]*))?\}", env, text))
    if not spec.get("name"):
        raise ManifestError("a program needs a name")
    networks = [n["name"] for n in spec.get("networks", [])]
    if len(networks) != len(set(networks)):
        raise ManifestError("a network is there twice")
    for c in spec.get("contracts", []):
        for d in c.get("details", []):
            if d["network"] not in networks:
                raise ManifestError(f"contract {c['name']}: no network {d['network']!r}")
            if d.get("start_block") and d.get("end_block") and int(d["start_block"]) > int(d["end_block"]):
                raise ManifestError(f"contract {c['name']}: it ends before it starts")
    for c in spec.get("contracts", []):
        own = abi.load_events(c["abi"] if isinstance(c["abi"], str) else json.dumps(c["abi"])) if c.get("abi") else {}
        types = {e.name: {p.name: p.type for p in e.params} for e in own.values()}
        c["events"] = own
        c["tables"] = [table({"metadata": bool(own)} | t, types) for t in c.get("tables", [])]
    return spec | {"tables": [t for c in spec.get("contracts", []) for t in c["tables"]]}
