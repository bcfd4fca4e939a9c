"""The expression language of filters and values: text -> tree -> Column, or value by interpretation.

Filters: || && ! over comparisons of arithmetic terms; + - * / ^ on whole numbers (checked: overflow,
negative results and division by zero are errors); fields as name, $name or @name (@: the row of the
table being written) with .key and [i]; numbers, 0x numbers, true/false and quoted text. Numbers are of up to 256
bits: expressions that cannot pass 38 digits are decimals, others text of functions.u256. An error
makes the filter false. Errors are nulls inside: AND and OR look at the left side first and at the right one
only if they must, as a sequential evaluation would, which SQL's three-valued logic would not do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions import u256

WIDE = "decimal(38,0)"
LIMIT = 10**38


class ExprError(ValueError):
    """Text that is not an expression."""


@dataclass(frozen=True)
class Lit:
    value: Any  # int, Decimal, bool or str


@dataclass(frozen=True)
class Field:
    table: bool  # @: the written table's row, else the event
    path: tuple[str | int, ...]


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


_TOKEN = re.compile(
    r"\s*(?:(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<hex>0[xX][0-9a-fA-F]+)|(?P<num>\d+(?:\.\d+)?)"
    r"|(?P<field>[$@]?[A-Za-z_]\w*(?:\.\w+|\[\d+\])*)|(?P<op>\|\||&&|==|!=|>=|<=|[-+*/^<>!()]))"
)
_NUMERAL = re.compile(r"-?(?:\d{1,78}|0[xX][0-9a-fA-F]{1,64})")
_COMPARE = ("==", "!=", ">=", "<=", ">", "<")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExprError(f"not an expression at {at}: {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.rest = _tokens(text)

    def peek(self) -> str | None:
        return self.rest[0][1] if self.rest and self.rest[0][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        return self.rest.pop(0)[1] if self.peek() in ops else None

    def left(self, below: Callable, *ops: str):
        out = below()
        while op := self.take(*ops):
            out = Op(op, (out, below()))
        return out

    def either(self):
        return self.left(self.both, "||")

    def both(self):
        return self.left(self.term, "&&")

    def term(self):
        if self.take("!"):
            return Op("!", (self.term(),))
        if self.peek() == "(":
            # A bracket may open a condition or an arithmetic term.
            kept = list(self.rest)
            try:
                self.take("(")
                inner = self.either()
                if not self.take(")"):
                    raise ExprError("a bracket is not closed")
                if self.peek() in (*_COMPARE, "+", "-", "*", "/", "^"):
                    raise ExprError("arithmetic")
                return inner
            except ExprError:
                self.rest = kept
        return self.condition()

    def condition(self):
        a = self.sum()
        op = self.take(*_COMPARE)
        if not op:
            raise ExprError("a comparison is missing")
        return Op(op, (a, self.sum()))

    def sum(self):
        return self.left(self.product, "+", "-")

    def product(self):
        return self.left(self.power, "*", "/")

    def power(self):
        return self.left(self.atom, "^")

    def atom(self):
        if self.take("("):
            out = self.sum()
            if not self.take(")"):
                raise ExprError("a bracket is not closed")
            return out
        sign = -1 if self.take("-") else 1
        if not self.rest:
            raise ExprError("the expression ends early")
        kind, text = self.rest.pop(0)
        if kind == "num":
            return Lit(sign * (Decimal(text) if "." in text else int(text)))
        if sign < 0 or kind == "op":
            raise ExprError(f"unexpected {text!r}")
        if kind == "hex":
            return Lit(text) if len(text) in (42, 66) else Lit(int(text, 16))
        if kind == "text":
            return Lit(text[1:-1])
        if text in ("true", "false"):
            return Lit(text == "true")
        return field(text)


def field(text: str) -> Field:
    parts = re.findall(r"\.?(\w+)|\[(\d+)\]", text.lstrip("$@"))
    return Field(text[0] == "@", tuple(int(i) if i else (int(k) if k.isdigit() and n else k) for n, (k, i) in enumerate(parts)))


def parse(text: str):
    """The tree of a filter."""
    p = _Parser(text)
    out = p.either()
    if p.rest:
        raise ExprError(f"unexpected {p.rest[0][1]!r}")
    return out


def parse_value(text: str):
    """The tree of an arithmetic formula."""
    p = _Parser(text)
    out = p.sum()
    if p.rest:
        raise ExprError(f"unexpected {p.rest[0][1]!r}")
    return out


def fields(tree) -> set[Field]:
    if isinstance(tree, Field):
        return {tree}
    return set().union(*map(fields, tree.args)) if isinstance(tree, Op) else set()


# --- to Columns ---------------------------------------------------------------------------------

Resolve = Callable[[Field], tuple[Column, T.DataType]]


def resolver(event: T.StructType, table: T.StructType | None = None, event_prefix: str = "", table_prefix: str = "") -> Resolve:
    """Looks fields up in schemas. Paths are null-safe: what is not there is null."""

    def find(f: Field) -> tuple[Column, T.DataType]:
        schema, prefix = (table, table_prefix) if f.table else (event, event_prefix)
        name = f.path[0]
        if schema is None or name not in schema.names:
            raise ExprError(f"no field {name!r}")
        c, kind = F.col(f"{prefix}`{name}`"), schema[name].dataType
        for step in f.path[1:]:
            if isinstance(kind, T.StructType):
                own = kind[step] if isinstance(step, str) else kind.fields[step]
                c, kind = c.getField(own.name), own.dataType
            elif isinstance(kind, T.ArrayType):
                c, kind = F.try_element_at(c, F.lit(int(step) + 1)), kind.elementType
            elif isinstance(kind, T.StringType):  # JSON text
                c = F.get_json_object(c, f"$[{step}]" if isinstance(step, int) else f"$.{step}")
            else:
                raise ExprError(f"{f.path} leads into a {kind.simpleString()}")
        return c, kind

    return find


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.FloatType, T.DoubleType)) or isinstance(t, T.DecimalType) and t.scale:
        return "fixed"
    if isinstance(t, T.NumericType):
        return "int"
    return "array" if isinstance(t, T.ArrayType) else "text"


def _width(tree, find: Resolve) -> int:
    """A bound of the decimal digits of an arithmetic tree's whole numbers; of text 78."""
    if isinstance(tree, Lit):
        return len(str(abs(tree.value))) if isinstance(tree.value, int) else 78 if isinstance(tree.value, str) else 0
    if isinstance(tree, Field):
        t = find(tree)[1]
        by_type = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
        return t.precision if isinstance(t, T.DecimalType) else by_type.get(type(t), 0 if _kind(t) == "fixed" else 78)
    a, b = (_width(x, find) for x in tree.args)
    if tree.name == "^":
        n = tree.args[1].value if isinstance(tree.args[1], Lit) else None
        return a * n if isinstance(n, int) and a else 78
    return a + b if tree.name == "*" else max(a, b) + 1 if tree.name == "+" else a


def wide(c: Column, kind: str) -> Column:
    """A value as signed digits of functions.u256; null if it is no whole number."""
    return c if kind == "wide" else u256.from_whole(c) if kind == "int" else u256.parsed(c) if kind == "text" else F.lit(None).cast("string")


def _column(tree, find: Resolve) -> tuple[Column, str]:
    if isinstance(tree, Lit):
        v = tree.value
        if isinstance(v, bool):
            return F.lit(v), "bool"
        if isinstance(v, int):
            return (F.lit(str(v)).cast(WIDE), "int") if abs(v) < LIMIT else (u256.literal(v), "wide")
        if isinstance(v, Decimal):
            return F.lit(float(v)), "fixed"
        return F.lit(v), "text"
    if isinstance(tree, Field):
        c, t = find(tree)
        kind = _kind(t)
        return (c.cast(WIDE) if kind == "int" else c.cast("double") if kind == "fixed" else c), kind
    (a, ka), (b, kb) = (_column(x, find) for x in tree.args)
    if "bool" in (ka, kb) or "array" in (ka, kb):
        raise ExprError("no arithmetic with booleans and arrays")
    if "fixed" in (ka, kb):
        a, b = (_double(x, k) for x, k in ((a, ka), (b, kb)))
        if tree.name == "/":
            return F.try_divide(a, b), "fixed"
        return {"+": a + b, "-": a - b, "*": a * b, "^": F.pow(a, b)}[tree.name], "fixed"
    if tree.name == "^" and all(isinstance(x, Lit) for x in tree.args):
        if not all(isinstance(x.value, int) for x in tree.args) or not 0 <= tree.args[1].value <= 256:
            raise ExprError("a power needs whole numbers")
        return _column(Lit(tree.args[0].value ** tree.args[1].value), find)
    if {ka, kb} != {"int"} or _width(tree, find) > 38:
        return _interpreted(tree, find), "wide"
    if tree.name == "+":
        return F.try_add(a, b).cast(WIDE), "int"
    if tree.name == "-":
        return F.when(a >= b, F.try_subtract(a, b).cast(WIDE)), "int"
    if tree.name == "*":
        return F.try_multiply(a, b).cast(WIDE), "int"
    if tree.name == "/":
        return F.when(b != 0, _whole_quotient(a, b)), "int"
    out = F.lit(1).cast(WIDE)
    for _ in range(tree.args[1].value):
        out = F.try_multiply(out, a).cast(WIDE)
    return out, "int"


def _interpreted(tree: Op, find: Resolve) -> Column:
    """The signed digits of an arithmetic tree of wide numbers: one Arrow batch for the whole tree, by evaluate()."""
    leaves = sorted(fields(tree), key=repr)

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            try:
                v = evaluate(tree, dict(zip(leaves, row, strict=True)), look=_leaf)
            except _Failed:
                v = None
            out.append(u256.digits(v) if isinstance(v, int) else None)
        return pd.Series(out, dtype=object)

    return run(*(find(f)[0].cast("string") for f in leaves))


def _double(c: Column, kind: str) -> Column:
    return c.cast("double") if kind in ("int", "fixed") else u256.to_decimal(wide(c, kind)).cast("double") if kind == "wide" else F.coalesce(c.try_cast("double"), u256.to_decimal(wide(c, kind)).try_cast("double"))


def _whole_quotient(a: Column, b: Column) -> Column:
    """The quotient rounded down, exact: what DecimalType keeps of it is less the remainder's share."""
    return F.try_divide(a - F.try_mod(a, b), b).cast(WIDE)


def _plain(tree: Op, find: Resolve) -> tuple[Column, Column] | None:
    """Both sides of a comparison between whole-number columns, or one and a literal, without casts; else None."""
    sides = []
    for x in tree.args:
        if isinstance(x, Field):
            c, t = find(x)
            if not isinstance(t, T.IntegralType):
                return None
            sides.append(c)
        elif isinstance(x, Lit) and isinstance(x.value, int) and not isinstance(x.value, bool) and abs(x.value) < 1 << 63:
            sides.append(F.lit(x.value))
        else:
            return None
    return tuple(sides)


def _compare(tree: Op, find: Resolve) -> Column:
    (a, ka), (b, kb) = (_column(x, find) for x in tree.args)
    kinds = {ka, kb}
    null = F.lit(None).cast("boolean")
    test = lambda x, y: {"==": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[tree.name]
    if plain := _plain(tree, find):
        return test(*plain)
    if kinds == {"int"}:
        return test(a, b)
    if "fixed" in kinds and kinds <= {"int", "fixed", "wide", "text"}:
        return test(_double(a, ka), _double(b, kb))
    for c, kind, other, left in ((a, ka, tree.args[1], True), (b, kb, tree.args[0], False)):
        if kind == "text" and isinstance(other, Lit) and isinstance(other.value, int) and abs(other.value) < u256.TOP:
            return _against(c, other.value, test if left else lambda x, y: test(y, x))
    if kinds & {"int", "wide"} and kinds <= {"int", "wide", "text"}:
        return test(u256.sortable(wide(a, ka)), u256.sortable(wide(b, kb)))
    if kinds == {"text"}:
        return _texts(tree, a, b, test)
    return test(a, b) if len(kinds) == 1 and tree.name in ("==", "!=") else null


_DECIMAL, _HEXA = r"^\d{1,78}$", "^0[xX][0-9a-fA-F]{1,64}$"


def _padded(c: Column) -> tuple[Column, Column]:
    """Decimal text and 0x text so that each compares among its kind."""
    return F.lpad(c, 78, "0"), F.lpad(F.lower(F.substring(c, 3, 64)), 64, "0")


def _against(c: Column, number: int, test: Callable) -> Column:
    """Text against a whole number: decimal text by its padded digits, 0x text by its own, without converting either."""
    decimal, hexa = _padded(c)
    fits = c.rlike(_DECIMAL) & (decimal < f"{u256.TOP:078d}")
    above, below = test(F.lit(1), F.lit(0)), test(F.lit(0), F.lit(1))
    if number >= 0:
        out = F.when(fits, test(decimal, F.lit(f"{number:078d}"))).when(c.rlike(_HEXA), test(hexa, F.lit(f"{number:064x}")))
        return out.when(c.rlike(r"^-\d{1,78}$"), below)
    # Of two negative numbers the one of the smaller magnitude is larger.
    return F.when(fits | c.rlike(_HEXA), above).when(c.rlike(r"^-\d{1,78}$"), test(F.lit(f"{-number:078d}"), F.lpad(F.substring(c, 2, 78), 78, "0")))


def _texts(tree: Op, a: Column, b: Column, test: Callable) -> Column:
    """Texts that both are numbers (decimal or 0x) compare as such, others only for equality, without case and 0x."""
    same = tree.name in ("==", "!=")
    alike = test(*(F.regexp_replace(F.lower(x), "^0x", "") for x in (a, b))) if same else F.lit(None).cast("boolean")
    for c, other, left in ((a, tree.args[1], True), (b, tree.args[0], False)):
        if isinstance(other, Lit):
            number = u256.number(other.value)
            return alike if number is None or abs(number) >= u256.TOP else F.coalesce(_against(c, number, test if left else lambda x, y: test(y, x)), alike)
    (da, ha), (db, hb) = _padded(a), _padded(b)
    both = lambda pattern: a.rlike(pattern) & b.rlike(pattern)
    x, y = (u256.sortable(u256.converted(c)) for c in (a, b))
    out = F.when(both(_HEXA), test(ha, hb)).when(both(_DECIMAL), test(da, db))
    return out.when(both(f"^{_NUMERAL.pattern}$"), test(x, y)).otherwise(alike)


def _condition(tree, find: Resolve, root: bool = False) -> Column:
    """At the root only being true counts, so an AND needs no regard to the order of errors and reaches file scans."""
    if tree.name == "!":
        return ~_condition(tree.args[0], find)
    if tree.name == "&&":
        a, b = (_condition(x, find, root) for x in tree.args)
        return a & b if root else a & (~a | b)
    if tree.name == "||":
        a = _condition(tree.args[0], find)
        return a | (~a & _condition(tree.args[1], find, root))
    return _compare(tree, find)


def condition(text: str, find: Resolve) -> Column:
    """A filter as a Column that is true or false, never null."""
    return F.coalesce(_condition(parse(text), find, True), F.lit(False))


def test(text: str, find: Resolve) -> Column:
    """A filter for where(): true where it holds, else false or null. Plain comparisons, which scans can take."""
    return _condition(parse(text), find, True)


def formula(text: str, find: Resolve) -> Column:
    """An arithmetic formula as a Column; an error is null."""
    return _column(parse_value(text), find)[0]


def legacy(conditions: list[Mapping[str, str]], find: Resolve, known: set[str]) -> Column:
    """A list of {path: "condition"}, for where(): all must hold; a path that is not known fails; no operator: equality."""
    out = F.lit(True)
    for entry in conditions:
        for path, wanted in entry.items():
            if path.split(".")[0].split("[")[0] not in known:
                return F.lit(False)
            joined = re.sub(r"(==|!=|>=|<=|>|<)", rf" {path} \1", wanted) if re.search(r"[<>=!]", wanted) else f"{path} == '{wanted}'"
            out = out & test(joined, find)
    return out


# --- by interpretation --------------------------------------------------------------------------


class _Failed(Exception):
    pass


def _look(f: Field, event: Mapping, table: Mapping | None):
    at = table if f.table else event
    for step in f.path:
        try:
            at = at[step]
        except (KeyError, IndexError, TypeError) as e:
            raise _Failed from e
    if at is None or at != at:
        raise _Failed
    return at


def _as_number(v):
    if isinstance(v, bool):
        raise _Failed
    if isinstance(v, str):
        if re.fullmatch(r"0[xX][0-9a-fA-F]+", v):
            return int(v, 16)
        if re.fullmatch(r"-?\d+", v):
            return int(v)
        raise _Failed
    return v


def _leaf(f: Field, event: Mapping, table: Mapping | None):
    """A field's value where event has it under the field itself."""
    v = event[f]
    if not isinstance(v, str):
        raise _Failed
    return v


def evaluate(tree, event: Mapping, table: Mapping | None = None, look: Callable = _look):
    """The value of a tree for one event and, for @fields, one table row. Raises on errors; see holds()."""
    if isinstance(tree, Lit):
        return tree.value
    if isinstance(tree, Field):
        return look(tree, event, table)
    if tree.name == "!":
        return not evaluate(tree.args[0], event, table, look)
    a = evaluate(tree.args[0], event, table, look)
    if tree.name == "&&":
        return bool(a) and evaluate(tree.args[1], event, table, look)
    if tree.name == "||":
        return bool(a) or evaluate(tree.args[1], event, table, look)
    b = evaluate(tree.args[1], event, table, look)
    if tree.name in _COMPARE:
        if isinstance(a, str) != isinstance(b, str) and not isinstance(a, bool) and not isinstance(b, bool):
            a, b = _as_number(a), _as_number(b)
        elif isinstance(a, str):
            if _NUMERAL.fullmatch(a) and _NUMERAL.fullmatch(b):
                a, b = _as_number(a), _as_number(b)
            elif tree.name in ("==", "!="):
                a, b = (re.sub("^0x", "", x.lower()) for x in (a, b))
            else:
                raise _Failed
        elif isinstance(a, bool) != isinstance(b, bool):
            raise _Failed
        if isinstance(a, float) or isinstance(b, float):
            a, b = float(a), float(b)
        return {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[tree.name]
    a, b = _as_number(a), _as_number(b)
    if isinstance(a, (float, Decimal)) or isinstance(b, (float, Decimal)):
        a, b = float(a), float(b)
        if tree.name == "/" and not b:
            raise _Failed
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**b}[tree.name]()
    if tree.name == "/" and not b or tree.name == "^" and (b < 0 or b > 256 and abs(a) > 1):
        raise _Failed
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a // b, "^": lambda: a**b}[tree.name]()
    if tree.name == "-" and out < 0 or abs(out) >= 1 << 256:
        raise _Failed
    return out


def holds(tree, event: Mapping, table: Mapping | None = None) -> bool:
    """Whether a filter's tree holds; errors make it false."""
    try:
        return bool(evaluate(tree, event, table))
    except _Failed:
        return False
