"""256-bit whole numbers in columns: 64 hex digits, computed with in eight limbs of 32 bits.

Comparison of the padded digits is that of the numbers. A negative number is "-" and the digits of its
magnitude; sortable() compares those too. Stored columns have 0x before the digits, so that they are read back
as what they are. Sums, differences and comparisons stay in the JVM; conversion from and to decimal text, products,
quotients and powers are Arrow batches of Python integers. Whatever leaves the range is null, the engine's mark of an error.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS, LIMBS = 256, 8
TOP = 1 << BITS
_ZERO = "0" * 64
_NUMERAL = re.compile(r"-?(?:\d{1,78}|0[xX][0-9a-fA-F]{1,64})", re.ASCII)


def _let(c: Column, use) -> Column:
    """use(c), c being computed once however often use names it: expressions stay small."""
    return F.transform(F.array(c), use)[0]


def from_hex(c: Column) -> Column:
    """Padded digits of hex text with or without 0x; null if it is none or too long."""
    digits = F.lower(F.regexp_replace(c, "^0[xX]", ""))
    return F.when(digits.rlike("^[0-9a-f]{1,64}$"), F.lpad(digits, 64, "0"))


def from_long(c: Column) -> Column:
    return F.when(c >= 0, F.lpad(F.lower(F.hex(c.cast("long"))), 64, "0"))


def literal(value: int) -> Column:
    """A number of either sign."""
    return F.lit(("-" if value < 0 else "") + f"{abs(value):064x}" if abs(value) < TOP else None).cast("string")


def from_whole(c: Column) -> Column:
    """Signed digits of a whole-number column of up to 38 digits."""
    unit = F.lit(str(1 << 60)).cast("decimal(19,0)")
    part = lambda x, n: F.lpad(F.lower(F.hex(x.cast("long"))), n, "0")
    above = lambda x: F.try_divide(x - F.try_mod(x, unit), unit).cast("decimal(38,0)")
    low = lambda x: part(F.try_mod(x, unit), 15)
    digits = lambda x: _let(above(x), lambda y: F.concat(part(above(y), 34), low(y), low(x)))
    return _let(c.cast("decimal(38,0)"), lambda x: F.concat(F.when(x < 0, "-").otherwise(""), digits(F.abs(x))))


def _converted(c: Column) -> Column:
    """from_decimal() in the JVM, for conditions that seldom need it: slower, but only where it is looked at.

    The text is A * 10^52 + B * 10^26 + C; the parts are multiplied out in places of 16 bits.
    """
    text = F.lpad(F.when(c.rlike(r"^\d{1,78}$"), c), 78, "0")
    part = lambda t, k: from_whole(F.substring(t, 1 + 26 * k, 26).cast("decimal(26,0)"))
    place = lambda digits, i: F.conv(F.substring(digits, 61 - 4 * i, 4), 16, 10).cast("long")
    parts = _let(text, lambda t: F.array(*(place(d, i) for d in (part(t, k) for k in range(3)) for i in range(6))))
    unit = [[(10**e >> 16 * j) & 0xFFFF for j in range(17)] for e in (52, 26, 0)]

    def product(p: Column, k: int) -> Column:
        terms = [p[6 * n + i] * unit[n][k - i] for n in range(3) for i in range(6) if 0 <= k - i < 17 and unit[n][k - i]]
        return reduce(lambda x, y: x + y, terms, F.lit(0).cast("long"))

    def carried(p: Column) -> Column:
        out, carry = [], F.lit(0).cast("long")
        for k in range(17):
            whole = p[k] + carry
            out.append(F.lpad(F.lower(F.hex(whole.bitwiseAND(F.lit(0xFFFF)))), 4, "0"))
            carry = F.shiftright(whole, 16)
        return F.when((out[16] == "0000") & (carry == 0), F.concat(*reversed(out[:16])))

    wide = _let(parts, lambda p: F.array(*(product(p, k) for k in range(17))))
    short = F.when(c.rlike(r"^\d{1,18}$"), F.lpad(F.lower(F.hex(c.try_cast("long"))), 64, "0"))
    return F.coalesce(short, F.when(text.isNotNull(), _let(wide, carried)))


def digits(v: int) -> str | None:
    """The signed digits of a whole number."""
    return f"{'-' if v < 0 else ''}{abs(v):064x}" if abs(v) < TOP else None


def number(text) -> int | None:
    """The whole number of decimal or 0x text of either sign, else None."""
    if not isinstance(text, str) or not _NUMERAL.fullmatch(text):
        return None
    bare = text.lstrip("-")
    v = int(bare, 16) if bare[:2] in ("0x", "0X") else int(bare)
    return -v if text[0] == "-" else v


def _texts(fn):
    """A pandas UDF of one text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fn(t) for t in texts], dtype=object)

    return run


def from_decimal(c: Column) -> Column:
    """Padded digits of decimal text; null if it is none or too large."""
    return _texts(lambda t: digits(int(t)) if isinstance(t, str) and t.isascii() and t.isdigit() else None)(c)


def to_decimal(c: Column) -> Column:
    """Decimal text of digits of either sign, with or without 0x."""
    return _texts(lambda t: str(int(t, 16)) if isinstance(t, str) else None)(c)


def parsed(c: Column) -> Column:
    """Signed digits of decimal or 0x text; null if it is neither."""
    return _texts(lambda t: None if (v := number(t)) is None else digits(v))(c)


def converted(c: Column) -> Column:
    """parsed() in the JVM; see _converted()."""

    def signed(text: Column) -> Column:
        bare = F.regexp_replace(text, "^-", "")
        own = F.when(bare.rlike("^0[xX]"), from_hex(bare)).otherwise(_converted(bare))
        return _let(own, lambda d: F.when(text.startswith("-") & (d != _ZERO), F.concat(F.lit("-"), d)).otherwise(d))

    return _let(c, signed)


def from_word(c: Column) -> Column:
    """Signed digits of a two's complement word of 64 hex digits."""
    magnitude = lambda x: _carried([y + (1 if k == 0 else 0) for k, y in enumerate(limbs(F.translate(x, "0123456789abcdef", "fedcba9876543210")))])
    return _let(c, lambda x: F.when(x.rlike("^[89a-f]"), F.concat(F.lit("-"), magnitude(x))).otherwise(x))


def sortable(c: Column) -> Column:
    """Text that compares as signed digits do: negative ones by the complement of their magnitude."""
    complement = F.translate(F.substring(c, 2, 64), "0123456789abcdef", "fedcba9876543210")
    return F.when(c.startswith("-"), F.concat(F.lit("0"), complement)).otherwise(F.concat(F.lit("1"), c))


def stored(c: Column) -> Column:
    """Signed digits as columns hold them."""
    return F.regexp_replace(c, "^(-?)", "$10x")


def _magnitude(c: Column) -> Column:
    return F.right(c, F.lit(64))


def limbs(c: Column) -> list[Column]:
    """Eight longs, the lowest first."""
    return [F.conv(F.substring(c, 64 - 8 * (k + 1) + 1, 8), 16, 10).cast("long") for k in range(LIMBS)]


def signed_limbs(c: Column) -> list[Column]:
    sign = F.when(c.startswith("-"), -1).otherwise(1)
    return [x * sign for x in limbs(_magnitude(c))]


def _carried(parts: list[Column]) -> Column:
    """Padded digits of limbs that may exceed 32 bits or be negative; null outside the range."""
    carry, out = F.lit(0).cast("long"), []
    for p in parts:
        whole = p + carry
        out.append(F.lpad(F.lower(F.hex(whole.bitwiseAND(0xFFFFFFFF))), 8, "0"))
        carry = F.shiftright(whole, 32)
    return F.when(carry == 0, F.concat(*reversed(out)))


def _signed(parts: list[Column]) -> Column:
    """Signed digits of such limbs."""
    return _let(F.array(*parts), lambda p: F.coalesce(_carried([p[k] for k in range(LIMBS)]), F.concat(F.lit("-"), _carried([-p[k] for k in range(LIMBS)]))))


def add(a: Column, b: Column) -> Column:
    return _carried([x + y for x, y in zip(limbs(a), limbs(b), strict=True)])


def subtract(a: Column, b: Column) -> Column:
    return _carried([x - y for x, y in zip(limbs(a), limbs(b), strict=True)])


def negated(c: Column) -> Column:
    """A number's negative."""
    return F.when(c.startswith("-"), F.substring(c, 2, 66)).otherwise(F.concat(F.lit("-"), c))


def signed_sum(c: Column) -> Column:
    """An aggregate: the sum of stored numbers, exact for fewer than 2^31 rows; null without any."""
    return stored(_signed([F.sum(x) for x in signed_limbs(c)]))


def signed_add(a: Column, b: Column) -> Column:
    """The sum of two stored numbers, null counting as 0."""
    zero = F.lit("0x" + _ZERO)
    both = F.struct(F.coalesce(a, zero).alias("a"), F.coalesce(b, zero).alias("b"))
    return _let(both, lambda s: stored(_signed([x + y for x, y in zip(signed_limbs(s["a"]), signed_limbs(s["b"]), strict=True)])))


def total(c: Column) -> Column:
    """An aggregate: the sum, exact for fewer than 2^31 rows."""
    return _carried([F.sum(x) for x in limbs(c)])


def _python(fn):
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            v = fn(int(x, 16), int(y, 16)) if isinstance(x, str) and isinstance(y, str) else None
            out.append(f"{v:064x}" if v is not None and 0 <= v < TOP else None)
        return pd.Series(out, dtype=object)

    return run


def multiply(a: Column, b: Column) -> Column:
    return _python(lambda x, y: x * y)(a, b)


def divide(a: Column, b: Column) -> Column:
    return _python(lambda x, y: x // y if y else None)(a, b)


def power(a: Column, b: Column) -> Column:
    return _python(lambda x, y: x**y if x < 2 or y <= BITS else None)(a, b)
