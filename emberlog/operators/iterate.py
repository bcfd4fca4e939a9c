"""Parallel arrays as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.plans import expr


def iterate(df: DataFrame, arrays: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row for each place of the arrays (path, alias), the aliases beside all other columns.

    Events whose arrays are missing or of unlike length go; empty arrays give no rows.
    """
    find = expr.resolver(df.schema)
    cols = [(find(expr.field(path))[0], alias) for path, alias in arrays]
    first = cols[0][0]
    fit = reduce(lambda a, b: a & b, (c.isNotNull() & (F.size(c) == F.size(first)) for c, _ in cols))
    held = df.where(F.coalesce(fit, F.lit(False))).withColumn("_each", F.explode(F.arrays_zip(*(c.alias(a) for c, a in cols))))
    return held.withColumns({a: F.col("_each")[a] for _, a in cols}).drop("_each")
