"""View calls as lookup joins: distinct requests are resolved once and joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def requests(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct calls that events need: (network, target, calldata, block), or without the block for static ones."""
    return df.select(*keys).distinct()


def with_calls(df: DataFrame, results: DataFrame | Callable[[DataFrame], DataFrame], keys: list[str], result: str = "result") -> DataFrame:
    """df with the result of each row's call, null where it failed. results: a table, or a function from distinct requests to one."""
    table = results(requests(df, keys)) if callable(results) else results
    return df.join(table.select(*keys, result).dropDuplicates(keys), keys, "left")
