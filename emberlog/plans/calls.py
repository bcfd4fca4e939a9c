"""View calls inside value expressions: $call(address, "f(types) returns (types)", args…)[i].name.

A call becomes a request (network, target, calldata, block), whose distinct values are resolved once
(operators.lookup) and joined back; in the expression its text gives way to a reference to the result.
$call_static has no block: its result is the same at every block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import u256
from emberlog.functions.keccak import keccak256
from emberlog.operators.lookup import with_calls
from emberlog.plans import expr
from emberlog.plans.values import split_args
from emberlog.sources import abi

_START = re.compile(r"\$call(_static)?\(")
_ACCESS = re.compile(r"(?:\[\d+\]|\.\w+)+")


@dataclass(frozen=True)
class Call:
    text: str  # with the accessor
    static: bool
    target: str
    signature: str  # name(types)
    returns: tuple[str, ...]
    args: tuple[str, ...]
    access: str = ""

    @property
    def selector(self) -> str:
        return keccak256(self.signature.encode())[:4].hex()


def find_calls(text: str) -> list[Call]:
    """The calls of an expression, in order."""
    out, at = [], 0
    while m := _START.search(text, at):
        depth, quote, i = 1, "", m.end()
        while depth:
            if i >= len(text):
                raise expr.ExprError(f"a call is not closed: {text!r}")
            ch = text[i]
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "\"'":
                quote = ch
            else:
                depth += (ch == "(") - (ch == ")")
            i += 1
        access = _ACCESS.match(text, i)
        end = access.end() if access else i
        target, signature, *args = split_args(text[m.end() : i - 1])
        sig = re.fullmatch(r"\s*(\w+)\(([^()]*)\)\s*(?:returns\s*\(([^()]*)\))?\s*", signature.strip("\"'"))
        if not sig:
            raise expr.ExprError(f"no signature: {signature!r}")
        kinds = [k.split()[0] for k in sig[2].split(",") if k.strip()]
        if len(kinds) != len(args):
            raise expr.ExprError(f"{len(args)} arguments for {signature!r}")
        returns = tuple(k.strip() for k in (sig[3] or "").split(",") if k.strip())
        out.append(Call(text[m.start() : end], bool(m[1]), target.strip(), f"{sig[1]}({','.join(kinds)})", returns, tuple(args), access[0] if access else ""))
        at = end
    return out


def _words(c: Column, kind: str) -> Column:
    """An argument as hex digits, without the offset of one of changing length; null if it does not fit its type."""
    if kind == "bool":
        return F.lpad(c.cast("boolean").cast("int").cast("string"), 64, "0")
    if kind == "string":
        raw = F.lower(F.hex(F.encode(c.cast("string"), "utf-8")))
        return F.concat(_count(F.length(raw) / 2), F.rpad(raw, F.ceil(F.length(raw) / 64) * 64, F.lit("0")))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own = abi.Param("", kind)
        out = []
        for t in texts:
            try:
                out.append(None if t is None else abi.encode([own], [json.loads(t) if listed else t]).hex()[64 * abi.is_dynamic(own) :])
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    listed = kind.endswith("]")
    return run(c if listed else c.cast("string"))


def _count(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c.cast("long"))), 64, "0")


def _value(text: str, find: expr.Resolve) -> Column:
    text = text.strip()
    return find(expr.field(text[1:]))[0] if text.startswith("$") else F.lit(text.strip("\"'"))


def requested(call: Call, find: expr.Resolve) -> tuple[Column, Column]:
    """(target, calldata) of a call; both lower-case 0x text."""
    kinds = [k for k in call.signature[call.signature.index("(") + 1 : -1].split(",") if k]
    own = [abi.Param("", k) for k in kinds]
    given = [(_value(a, find), k) for a, k in zip(call.args, kinds, strict=True)]
    # Arrays travel as JSON, whether they are columns or written out.
    listed = [F.to_json(c) if k.endswith("]") and a.strip().startswith("$") else c for a, (c, k) in zip(call.args, given, strict=True)]
    words = [_words(c, k) for c, k in zip(listed, kinds, strict=True)]
    at, head, tail = F.lit(sum(map(abi.head_size, own))), [], []
    for p, w in zip(own, words, strict=True):
        if abi.is_dynamic(p):
            head.append(_count(at))
            tail.append(w)
            at = at + F.length(w) / 2
        else:
            head.append(w)
    return F.lower(_value(call.target, find).cast("string")), F.concat(F.lit("0x" + call.selector), *head, *tail)


def resolve(df: DataFrame, text: str, results: Callable[[DataFrame], DataFrame], decode: Callable[[Column, Call], Column] | None = None, network: str = "network", block: str = "evt_block_number", first: int = 0) -> tuple[DataFrame, str]:
    """(df with a column call_<k> for each call of text, from k = first on; the text over these columns).

    results: from distinct (network, target, calldata, block) to the same with `result`, words as 0x
    text; block is null for static calls. A result's word is the first, the one that [i] names, or the one that .name
    names in the returns; numbers are decimal text, by their declared sign. decode replaces that.
    """
    plain = decode or _decoded
    for k, call in enumerate(find_calls(text), first):
        target, data = requested(call, expr.resolver(df.schema))
        asked = df.withColumns({"target": target, "calldata": data, "call_block": F.lit(None).cast("long") if call.static else F.col(block).cast("long")})
        keys = [network, "target", "calldata", "_block"]
        asked = asked.withColumn("_block", F.coalesce("call_block", F.lit(-1).cast("long")))
        answers = lambda rows: results(rows.withColumn("block", F.when(F.col("_block") >= 0, F.col("_block")))).withColumn("_block", F.coalesce("block", F.lit(-1).cast("long")))
        met = with_calls(asked, answers, keys)
        df = met.withColumn(f"call_{k}", plain(F.col("result"), call)).drop("target", "calldata", "call_block", "_block", "result")
        text = text.replace(call.text, f"$call_{k}", 1)
    return df, text


def _decoded(c: Column, call: Call) -> Column:
    """The word of a result that the call's accessor names; without stated returns what abi.guess() makes of it."""
    if not call.returns and not call.access:
        return _guessed(c)
    names = [r.split()[1] if len(r.split()) > 1 else None for r in call.returns]
    if m := re.fullmatch(r"\[(\d+)\]", call.access):
        place = int(m[1])
    elif call.access[1:] in names:
        place = names.index(call.access[1:])
    elif call.access:
        raise expr.ExprError(f"no result {call.access!r} in {call.signature!r}")
    else:
        place = 0
    kind = call.returns[place].split()[0] if place < len(call.returns) else "uint256"
    word = F.when(F.length(c) >= 2 + 64 * (place + 1), F.lower(F.substring(c, 3 + 64 * place, 64)))
    if kind == "address":
        return F.concat(F.lit("0x"), F.right(word, F.lit(40)))
    if kind == "bool":
        return ~word.rlike("^0*$")
    if kind.startswith("bytes") and kind != "bytes":
        return F.concat(F.lit("0x"), F.substring(word, 1, 2 * int(kind[5:])))
    if kind in ("bytes", "string"):
        return _guessed(c)
    return u256.to_decimal(u256.from_word(word) if kind.startswith("int") else word)


def _guessed(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(results: pd.Series) -> pd.Series:
        out = []
        for r in results:
            value = abi.guess(bytes.fromhex(r[2:])) if isinstance(r, str) else None
            out.append(value if value is None or isinstance(value, str) else "[" + ", ".join(value) + "]")
        return pd.Series(out, dtype=object)

    return run(c)
