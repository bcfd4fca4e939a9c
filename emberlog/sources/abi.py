"""Contract ABIs: signatures, topics, and decoding of logs into typed columns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import u256
from emberlog.functions.keccak import keccak256


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    indexed: bool = False
    parts: tuple[Param, ...] = ()

    @property
    def canonical(self) -> str:
        """The type with tuples spelled out."""
        if not self.type.startswith("tuple"):
            return self.type
        return "(" + ",".join(p.canonical for p in self.parts) + ")" + self.type[5:]


def param(spec: dict) -> Param:
    return Param(spec.get("name", ""), spec["type"], bool(spec.get("indexed")), tuple(param(c) for c in spec.get("components", ())))


@dataclass(frozen=True)
class Event:
    name: str
    params: tuple[Param, ...]

    @property
    def signature(self) -> str:
        return f"{self.name}({','.join(p.canonical for p in self.params)})"

    @property
    def topic(self) -> str:
        return "0x" + keccak256(self.signature.encode()).hex()


def load_events(text: str) -> dict[str, Event]:
    return {e["name"]: Event(e["name"], tuple(param(p) for p in e["inputs"])) for e in json.loads(text) if e.get("type") == "event"}


def _array_of(kind: str) -> tuple[str, int | None] | None:
    """(element type, fixed length) of T[] or T[n]."""
    if not kind.endswith("]"):
        return None
    base, _, n = kind[:-1].rpartition("[")
    return base, int(n) if n else None


def is_dynamic(p: Param) -> bool:
    if array := _array_of(p.type):
        return array[1] is None or is_dynamic(Param(p.name, array[0], False, p.parts))
    if p.type == "tuple":
        return any(map(is_dynamic, p.parts))
    return p.type in ("bytes", "string")


def head_size(p: Param) -> int:
    """Bytes that a value has among the heads."""
    if is_dynamic(p):
        return 32
    if array := _array_of(p.type):
        return array[1] * head_size(Param(p.name, array[0], False, p.parts))
    return sum(map(head_size, p.parts)) if p.type == "tuple" else 32


class DecodeError(ValueError):
    """Data that does not hold what the ABI says."""


def _word(data: bytes, at: int) -> bytes:
    if at < 0 or at + 32 > len(data):
        raise DecodeError("data ends early")
    return data[at : at + 32]


def _number(data: bytes, at: int) -> int:
    return int.from_bytes(_word(data, at), "big")


def _static(kind: str, word: bytes):
    if kind.startswith("uint"):
        return str(int.from_bytes(word, "big"))
    if kind.startswith("int"):
        return str(int.from_bytes(word, "big", signed=True))
    if kind == "address":
        return "0x" + word[12:].hex()
    if kind == "bool":
        return any(word)
    if kind.startswith("bytes"):
        return "0x" + word[: int(kind[5:])].hex()
    raise DecodeError(f"no type {kind!r}")


def _value(p: Param, data: bytes, at: int):
    if array := _array_of(p.type):
        n = array[1]
        if n is None:
            n, at = _number(data, at), at + 32
        if n > len(data):
            raise DecodeError("an array is longer than its data")
        return decode([Param("", array[0], False, p.parts)] * n, data[at:])
    if p.type == "tuple":
        return {part.name or str(k): v for k, (part, v) in enumerate(zip(p.parts, decode(list(p.parts), data[at:]), strict=True))}
    if p.type in ("bytes", "string"):
        n = _number(data, at)
        raw = data[at + 32 : at + 32 + n]
        if len(raw) < n:
            raise DecodeError("data ends early")
        return raw.decode("utf-8", "replace").replace("\0", "") if p.type == "string" else "0x" + raw.hex()
    return _static(p.type, _word(data, at))


def decode(params: list[Param], data: bytes) -> list:
    """The values of params: whole numbers as decimal text, bytes and addresses as 0x text, tuples as dicts."""
    out, at = [], 0
    for p in params:
        out.append(_value(p, data, _number(data, at) if is_dynamic(p) else at))
        at += head_size(p)
    return out


class EncodeError(ValueError):
    """A value that its ABI type does not hold."""


def _encoded(p: Param, v) -> bytes:
    if array := _array_of(p.type):
        if not isinstance(v, (list, tuple)) or array[1] not in (None, len(v)):
            raise EncodeError(f"{v!r} is no {p.type}")
        body = encode([Param("", array[0], False, p.parts)] * len(v), list(v))
        return body if array[1] is not None else len(v).to_bytes(32, "big") + body
    if p.type == "tuple":
        given = [v.get(part.name or str(k)) for k, part in enumerate(p.parts)] if isinstance(v, dict) else list(v)
        return encode(list(p.parts), given)
    if p.type in ("bytes", "string"):
        raw = str(v).encode() if p.type == "string" else bytes.fromhex(str(v).removeprefix("0x"))
        return len(raw).to_bytes(32, "big") + raw + bytes(-len(raw) % 32)
    if p.type == "bool":
        return int(v in (True, 1, "true", "1")).to_bytes(32, "big")
    if p.type.startswith("bytes"):
        raw = bytes.fromhex(str(v).removeprefix("0x"))
        if len(raw) > int(p.type[5:]):
            raise EncodeError(f"{v!r} is no {p.type}")
        return raw.ljust(32, b"\0")
    n = v if isinstance(v, int) else u256.number(str(v))
    if n is None or isinstance(v, bool):
        raise EncodeError(f"{v!r} is no {p.type}")
    bits = 160 if p.type == "address" else int(p.type.lstrip("uint") or 256)
    low, high = (-(1 << bits - 1), 1 << bits - 1) if p.type.startswith("int") else (0, 1 << bits)
    if not low <= n < high:
        raise EncodeError(f"{v!r} is no {p.type}")
    return n.to_bytes(32, "big", signed=n < 0)


def encode(params: list[Param], values: list) -> bytes:
    """What decode() reads: heads in a row, and behind them what is of changing length."""
    if len(params) != len(values) or any(v is None for v in values):
        raise EncodeError("a value is missing")
    head, tail, at = [], [], sum(map(head_size, params))
    for p, v in zip(params, values, strict=True):
        own = _encoded(p, v)
        if is_dynamic(p):
            head.append(at.to_bytes(32, "big"))
            tail.append(own)
            at += len(own)
        else:
            head.append(own)
    return b"".join(head + tail)


def spark_type(p: Param) -> str:
    if array := _array_of(p.type):
        return f"array<{spark_type(Param('', array[0], False, p.parts))}>"
    if p.type == "tuple":
        return "struct<" + ", ".join(f"`{q.name or k}`: {spark_type(q)}" for k, q in enumerate(p.parts)) + ">"
    return "boolean" if p.type == "bool" else "string"


def decode_logs(logs: DataFrame, event: Event) -> DataFrame:
    """logs (topics array<string>, data string, …) of the event with a column for each parameter.

    Logs with another first topic, another number of topics than indexed parameters, or data that
    does not decode go. Indexed text and arrays are the hash that the log holds.
    """
    indexed = [p for p in event.params if p.indexed]
    plain = [p for p in event.params if not p.indexed]
    keep = [c for c in logs.columns if c not in ("topics", "data")]
    names = [p.name or f"arg{k}" for k, p in enumerate(event.params)]

    def one(topics, data):
        raw = bytes.fromhex((data or "0x")[2:])
        body = iter(decode(plain, raw))
        words = iter(topics[1:])
        return [(lambda w: w if is_dynamic(p) or _array_of(p.type) or p.type == "tuple" else _static(p.type, bytes.fromhex(w[2:])))(next(words)) if p.indexed else next(body) for p in event.params]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, on = [], []
            for k, (topics, data) in enumerate(zip(pdf["topics"], pdf["data"], strict=True)):
                try:
                    rows.append(one(list(topics), data))
                    on.append(k)
                except (DecodeError, ValueError):
                    continue
            out = pdf.iloc[on][keep].reset_index(drop=True)
            for n, values in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True):
                out[n] = pd.Series(list(values), dtype=object)
            yield out

    fit = (F.try_element_at("topics", F.lit(1)) == event.topic) & (F.size("topics") == len(indexed) + 1)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in logs.schema if f.name in keep]
    kinds += [f"`{n}` {'string' if p.indexed and (is_dynamic(p) or _array_of(p.type) or p.type == 'tuple') else spark_type(p)}" for n, p in zip(names, event.params, strict=True)]
    return logs.where(fit).mapInPandas(run, ", ".join(kinds))


def is_plain(event: Event) -> bool:
    """Whether all parameters are words, so that decode_static() takes the event."""
    return not any(is_dynamic(p) or p.type == "tuple" or _array_of(p.type) for p in event.params)


def decode_static(logs: DataFrame, event: Event) -> DataFrame:
    """decode_logs() for events of static parameters, in JVM expressions, with the same columns."""
    if not is_plain(event):
        raise DecodeError(f"{event.name} is not static")
    out = logs.where((F.try_element_at("topics", F.lit(1)) == event.topic) & (F.size("topics") == 1 + sum(p.indexed for p in event.params)))
    out = out.select(F.struct("*").alias("row"))
    topic, word, cols = 1, 0, []
    for k, p in enumerate(event.params):
        if p.indexed:
            topic += 1
            c = F.substring(F.element_at("row.topics", topic), 3, 64)
        else:
            c = F.substring("row.data", 3 + 64 * word, 64)
            word += 1
        c = F.lower(c)
        if p.type == "address":
            c = F.concat(F.lit("0x"), F.substring(c, 25, 40))
        elif p.type == "bool":
            c = ~c.rlike("^0*$")
        elif p.type.startswith("bytes"):
            c = F.concat(F.lit("0x"), F.substring(c, 1, 2 * int(p.type[5:])))
        else:
            c = u256.to_decimal(u256.from_word(c) if p.type.startswith("int") else c)
        cols.append(c.alias(p.name or f"arg{k}"))
    names = [c for c in logs.columns if c not in ("topics", "data")]
    return out.where(F.length("row.data") >= 2 + 64 * word).select(*(F.col("row")[c].alias(c) for c in names), *cols)


def decoded(logs: DataFrame, event: Event) -> DataFrame:
    """The event's logs with a column for each parameter, natively where all are words."""
    return decode_static(logs, event) if is_plain(event) else decode_logs(logs, event)


def guess(data: bytes):
    """The value of a call whose return type is not stated.

    An offset of 32 and a fitting length are text (or bytes, if it is not printable), a word of printable
    bytes padded with zeros is text, several words are a tuple of numbers, and one word is a number.
    """
    if not data or len(data) % 32:
        return "0x" + data.hex()
    if len(data) >= 64 and _number(data, 0) == 32 and _number(data, 32) <= len(data) - 64 < _number(data, 32) + 32:
        raw = data[64 : 64 + _number(data, 32)]
        text = raw.decode("utf-8", "replace")
        return text if text.isprintable() and "\ufffd" not in text else "0x" + raw.hex()
    if len(data) == 32:
        text = data.rstrip(b"\0")
        if len(text) > 1 and data[0] and text.isascii() and text.decode().isprintable():
            return text.decode()
        return str(_number(data, 0))
    return tuple(str(_number(data, at)) for at in range(0, len(data), 32))
