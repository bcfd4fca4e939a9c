"""Values of derived columns: $field, $null, $if, $constant, formulas, templates, metadata and literals."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions import u256
from emberlog.plans import expr

_REF = re.compile(r"\$([A-Za-z_]\w*(?:\.\w+|\[\d+\])*)")
_CALL = re.compile(r"^\$(if|constant)\((.*)\)$", re.S)
# Spark types of the declared column types; for whole numbers that pass 38 digits see is_wide().
TYPES = {"string": "string", "address": "string", "bytes": "string", "bytes32": "string", "bool": "boolean", "timestamp": "timestamp"}


def spark_type(declared: str) -> str:
    """The Spark type of a declared type such as uint32, int64, address or uint256[]."""
    if declared.endswith("[]"):
        return f"array<{spark_type(declared[:-2])}>"
    if declared in TYPES:
        return TYPES[declared]
    m = re.fullmatch(r"(u?)int(\d+)", declared)
    if not m:
        if re.fullmatch(r"bytes\d+", declared):
            return "string"
        raise expr.ExprError(f"no column type {declared!r}")
    if is_wide(declared):
        return "string"
    bits = int(m[2]) - (0 if m[1] else 1)
    return "smallint" if bits <= 15 else "int" if bits <= 31 else "bigint" if bits <= 63 else "decimal(20,0)" if bits <= 64 else "decimal(38,0)"


def is_wide(declared: str) -> bool:
    """Whether a declared whole-number type can pass 38 digits; its columns are text of functions.u256."""
    m = re.fullmatch(r"(u?)int(\d+)", declared)
    return bool(m) and int(m[2]) > (126 if m[1] else 128)


def split_args(text: str) -> list[str]:
    """Arguments at commas outside brackets and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def _bare(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def coerce(c: Column, kind: str, declared: str) -> Column:
    """A value of expr's kind as a column of a declared type; what does not fit is null."""
    target = spark_type(declared)
    if is_wide(declared):
        if kind == "bool":
            c, kind = c.cast("int"), "int"
        return u256.stored(expr.wide(c, kind))
    if kind == "wide":
        if declared == "address":
            return F.concat(F.lit("0x"), F.right(F.when(~c.startswith("-"), c), F.lit(40)))
        c, kind = u256.to_decimal(c), "text"
    elif kind == "text" and re.fullmatch(r"u?int\d+", declared):
        return F.coalesce(c.try_cast(target), u256.to_decimal(u256.parsed(c)).try_cast(target))
    if declared == "bool":
        return c != 0 if kind == "int" else c.try_cast("boolean")
    if declared == "timestamp" and kind == "int":
        return F.timestamp_seconds(c.cast("long"))
    if declared == "address" and kind == "int":
        return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c.cast("long"))), 40, "0"))
    if kind == "bool" and target != "string":
        return c.cast("int").cast(target)
    return F.lower(c) if declared == "address" else c.try_cast(target)


def literal(text: str, declared: str) -> Column:
    text = _bare(text)
    if is_wide(declared):
        whole = int(text, 16) if re.fullmatch(r"0[xX][0-9a-fA-F]+", text) else int(text) if re.fullmatch(r"-?\d+", text) else u256.TOP
        return u256.stored(u256.literal(whole))
    if declared == "bool":
        return F.lit(text in ("true", "1"))
    if declared == "timestamp":
        return F.timestamp_seconds(F.lit(int(text))) if text.isdigit() else F.lit(text).try_cast("timestamp")
    return F.lit(text.lower() if declared == "address" else text).try_cast(spark_type(declared))


def constant(name: str, constants: Mapping, network: Column | None) -> Column:
    """A constant: one value, or one for each network."""
    if name not in constants:
        raise expr.ExprError(f"no constant {name!r}")
    value = constants[name]
    if not isinstance(value, Mapping):
        return F.lit(str(value))
    if network is None:
        raise expr.ExprError(f"constant {name!r} differs by network")
    return F.create_map(*(F.lit(str(x)) for pair in value.items() for x in pair))[network]


def template(text: str, find: expr.Resolve) -> Column:
    """Text with $refs put in; null if one of them is; a lone $ stays."""
    parts, at = [], 0
    for m in _REF.finditer(text):
        parts += [F.lit(text[at : m.start()]), find(expr.field(m[1]))[0].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def compile_value(text: str, declared: str, find: expr.Resolve, constants: Mapping | None = None, network: Column | None = None) -> Column:
    """A value expression as a column of the declared type. Errors at run time give null."""
    text = str(text).strip()
    again = lambda t: compile_value(t, declared, find, constants, network)
    if text == "$null":
        return F.lit(None).cast(spark_type(declared))
    if m := _CALL.match(text):
        args = split_args(m[2])
        if m[1] == "constant":
            return coerce(constant(_bare(args[0]), constants or {}, network), "text", declared)
        if len(args) != 3:
            raise expr.ExprError(f"$if takes three arguments: {text!r}")
        return F.when(expr.condition(args[0], find), again(args[1])).otherwise(again(args[2]))
    if _REF.fullmatch(text):
        c, t = find(expr.field(text))
        return coerce(c, expr._kind(t), declared)
    if "$" not in text and "@" not in text:
        try:
            tree = expr.parse_value(text)
        except expr.ExprError:
            return literal(text, declared)
        return coerce(*expr._column(tree, find), declared) if isinstance(tree, expr.Op) else literal(text, declared)
    # Quotes or words outside the references make it a template, else it is a formula.
    rest = _REF.sub("", text)
    if not re.search(r"[A-Za-z\"',:;]", rest) and re.search(r"[-+*/^]", rest):
        try:
            return coerce(*expr._column(expr.parse_value(text), find), declared)
        except expr.ExprError:
            pass
    return coerce(template(_bare(text), find), "text", declared)
