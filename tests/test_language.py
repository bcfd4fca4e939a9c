"""The expression language: grammar, errors, Columns against the interpreter."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberlog.plans import expr, values

ROWS = [
    (0, 0, 0.0, "Alpha", [1, 2], True, '{"k": 7}'),
    (1, 10, 0.5, "beta", [3], False, '{"k": 8}'),
    (2, 25, 1.5, "0x10", [], True, '{"a": {"b": [5]}}'),
    (3, None, None, None, None, None, None),
    (4, 10**30, 2.5, "12", [9, 9, 9], False, "{}"),
]
SCHEMA = "id long, v decimal(38,0), f double, s string, a array<int>, ok boolean, js string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, None if v is None else __import__("decimal").Decimal(v), *r) for i, v, *r in ROWS], SCHEMA).cache()


# Text, and the ids of the rows where it holds.
CASES = [
    ("v > 5 && f >= 0.5", [1, 2, 4]),
    ("v == 0xa", [1]),
    ("s == 'ALPHA' || s == \"BETA\"", [0, 1]),
    ("s == 16", [2]),
    ("s > 3", [2, 4]),
    ("s > 'a'", []),  # only == and != compare text
    ("ok == true", [0, 2]),
    ("ok == 1", []),
    ("!(v > 5)", [0]),  # the negation of an error is an error
    ("v - 5 >= 0", [1, 2, 4]),  # below zero is an error
    ("v / 0 == 0", []),
    ("1 == 1 || v / 0 == 1", [0, 1, 2, 3, 4]),  # the right side is not looked at
    ("v / 0 == 1 || 1 == 1", []),  # but the left side is
    ("1 == 2 && v / 0 == 1", []),
    ("!(1 == 2 && v / 0 == 1)", [0, 1, 2, 3, 4]),
    ("2 ^ 3 ^ 2 == 64", [0, 1, 2, 3, 4]),  # powers go from the left
    ("1 + 2 * 3 ^ 2 == 19", [0, 1, 2, 3, 4]),
    ("7 / 2 == 3", [0, 1, 2, 3, 4]),
    ("a[0] == 1", [0]),
    ("a[2] == 9", [4]),
    ("js.k == 7", [0]),
    ("v * 1000000000 > 5", [1, 2, 4]),  # 10^39 fits into 256 bits
    ("v ^ 3 > 0", [1, 2]),  # 10^90 does not
    ("v ^ 2 / 10 ^ 55 == 100000", [4]),
    ("v * v * 2 - v > 5", [1, 2, 4]),
    ("s + 1 == 17", [2]),
    ("s * 5 - 1 == 59", [4]),
    ("s < -1", []),
    ("s > -1 && s < v", [2, 4]),
    ("s != '0x10'", [0, 1, 4]),
    ("s == 'ALPHA' || s == '0X00010'", [0, 2]),
    ("(v + 1) * 2 == 22", [1]),
    ("((v > 5))", [1, 2, 4]),
    ("f == 1.5", [2]),
    ("-1 < v", [0, 1, 2, 4]),
]


@pytest.mark.parametrize("text,ids", CASES)
def test_conditions(df, text, ids):
    assert sorted(r["id"] for r in df.where(expr.condition(text, expr.resolver(df.schema))).collect()) == ids


@pytest.mark.parametrize("text", [t for t, _ in CASES if "js" not in t])
def test_interpreter_agrees(df, text):
    tree = expr.parse(text)
    want = sorted(r["id"] for r in df.where(expr.condition(text, expr.resolver(df.schema))).collect())
    got = []
    for r in df.collect():
        event = {k: int(v) if type(v).__name__ == "Decimal" else v for k, v in r.asDict().items()}
        if expr.holds(tree, event):
            got.append(r["id"])
    assert got == want


@pytest.mark.parametrize("text", ["", "v >", "v", "(v > 1", "v > 1)", "v == == 1", "v > 1 &&", "# > 1", "!v", "v ^ a == 1 extra"])
def test_bad_text(text):
    with pytest.raises(expr.ExprError):
        expr.parse(text)


def test_unknown_fields(df):
    with pytest.raises(expr.ExprError):
        expr.condition("nope == 1", expr.resolver(df.schema))


def test_legacy_conditions(df):
    find, known = expr.resolver(df.schema), set(df.columns)
    run = lambda c: sorted(r["id"] for r in df.where(expr.legacy(c, find, known)).collect())
    assert run([{"v": ">5"}, {"f": "<2"}]) == [1, 2]
    assert run([{"s": "alpha"}]) == [0] and run([{"nope": "1"}]) == []


def test_table_fields_are_told_apart():
    assert {(f.table, f.path) for f in expr.fields(expr.parse("$a.b[1] > @c && d == 1"))} == {(False, ("a", "b", 1)), (True, ("c",)), (False, ("d",))}
    assert expr.holds(expr.parse("$a > @a"), {"a": 2}, {"a": 1}) and not expr.holds(expr.parse("$a > @a"), {"a": 2}, None)


VALUES = [
    ("$v", "int64", [0, 10, 25, None, None]),
    ("$v * 2 + 1", "int128", [1, 21, 51, None, 2 * 10**30 + 1]),
    ("$v / 3", "int64", [0, 3, 8, None, None]),
    ("$v - 5", "int64", [None, 5, 20, None, None]),
    ("$if(v > 5, 'BUY', 'SELL')", "string", ["SELL", "BUY", "BUY", "SELL", "BUY"]),
    ("$if(s == 'a,b', 1, $if(v == 0, 2, 3))", "int64", [2, 3, 3, 3, 3]),
    ("$null", "string", [None] * 5),
    ('"$s-$id"', "string", ["Alpha-0", "beta-1", "0x10-2", None, "12-4"]),
    ("cost $ $id", "string", ["cost $ 0", "cost $ 1", "cost $ 2", "cost $ 3", "cost $ 4"]),
    ("$ok", "int64", [1, 0, 1, None, 0]),
    ("$id", "bool", [False, True, True, True, True]),
    ("$a[1]", "int64", [2, None, None, None, 9]),
    ("7", "uint8", [7] * 5),
    ("'7'", "string", ["7"] * 5),
    ("true", "bool", [True] * 5),
]


@pytest.mark.parametrize("text,kind,want", VALUES)
def test_values(df, text, kind, want):
    c = values.compile_value(text, kind, expr.resolver(df.schema))
    assert [None if r["x"] is None else int(r["x"]) if type(r["x"]).__name__ == "Decimal" else r["x"] for r in df.select("id", c.alias("x")).orderBy("id").collect()] == want


def test_constants(df):
    find = expr.resolver(df.schema)
    per_network = {"fee": {"Alpha": 5, "beta": 6}, "one": 1}
    c = values.compile_value("$constant(fee)", "int64", find, per_network, F.col("s"))
    assert [r["x"] for r in df.orderBy("id").select(c.alias("x")).collect()] == [5, 6, None, None, None]
    assert df.select(values.compile_value("$constant(one)", "int64", find, per_network).alias("x")).first()["x"] == 1
    with pytest.raises(expr.ExprError):
        values.compile_value("$constant(no)", "int64", find, per_network)
    with pytest.raises(expr.ExprError):
        values.compile_value("$if(v > 1, 2)", "int64", find)


def test_timestamps_and_addresses(df):
    find = expr.resolver(df.schema)
    c = values.compile_value("$id", "timestamp", find)
    assert df.where("id = 1").select(F.unix_timestamp(c).alias("x")).first()["x"] == 1
    c = values.compile_value("$id", "address", find)
    assert df.where("id = 1").select(c.alias("x")).first()["x"] == "0x" + "0" * 39 + "1"
