"""URL filtering by stated rules and by mined association rules.

Stated rules (host and path prefix) decide first; the longest that fits wins. Every other URL is
judged by rules that FP-growth mines from labelled URLs: combinations of tokens of host and path that
imply "bad" with enough support and confidence, of which only those without a smaller rule inside
are kept. They are matched through an inverted index from token to rules, without a shuffle.

A URL that is null or has no "://" has an empty host and path, no tokens, and is allowed. With no
labelled rows, or none that are bad, nothing is mined. Repeated rows are judged each for itself, ids may be null, and
other columns are not read, whatever their names.

What is mined reaches the driver: combinations that hold in at least the support's share of rows. Tokens of one URL
are few, and with a support of 0.2 % at most 500 tokens of each place of a URL can be frequent.
"""

from __future__ import annotations

import string
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
_BAD = "\x00bad"


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: str, path: str) -> Column:
    """The distinct words of host and path, lower-case, without numbers."""
    words = F.split(F.lower(F.concat_ws("/", F.col(host), F.col(path))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.rlike(r"^\p{N}+$")))


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.9, least: int = 10) -> list[tuple[str, ...]]:
    """Token combinations that imply "bad". labelled: tokens array<string>, bad boolean.

    Support bounds the result: a combination holds in at least that share of the labelled rows, and
    in at least `least` of them.
    """
    items = labelled.where("bad is not null").select(F.when(F.col("bad"), F.array_union("tokens", F.array(F.lit(_BAD)))).otherwise(F.col("tokens")).alias("items"))
    rows, bad = items.agg(F.count("*"), F.count_if(F.array_contains("items", _BAD))).first()
    if bad < least:
        return []
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / rows), minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", _BAD)).select("antecedent").collect()
    kept: list[frozenset[str]] = []
    by_token: dict[str, list[frozenset[str]]] = defaultdict(list)
    for rule in sorted((frozenset(r["antecedent"]) for r in rules), key=lambda r: (len(r), sorted(r))):
        if not any(k <= rule for t in rule for k in by_token[t]):
            kept.append(rule)
            for t in rule:
                by_token[t].append(rule)
    return [tuple(sorted(r)) for r in kept]


def matcher(mined: list[tuple[str, ...]]):
    """A function (tokens Column) -> the first mined rule that fits, its tokens joined by "+", else null."""
    index: dict[str, list[int]] = defaultdict(list)
    for k, rule in enumerate(mined):
        for t in rule:
            index[t].append(k)
    index = dict(index)
    need = np.array([len(r) for r in mined])
    names = ["+".join(r) for r in mined]

    @F.pandas_udf("string")
    def match(tokens: pd.Series) -> pd.Series:
        out = []
        for row in tokens:
            hits: dict[int, int] = defaultdict(int)
            for t in row if row is not None else ():
                for k in index.get(t, ()):
                    hits[k] += 1
            out.append(names[k] if (k := min((k for k, n in hits.items() if n == need[k]), default=None)) is not None else None)
        return pd.Series(out, dtype=object)

    return match


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: list[tuple[str, ...]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, mined_rule). rules: (verdict, host, path prefix)."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    own = own.select("id", host_of("url").alias("host"), path_of("url").alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    own = own.withColumns({"rule": rule, "stated": verdict})
    own = own.withColumn("mined_rule", matcher(mined)(tokens_of("host", "path")) if mined else F.lit(None).cast("string"))
    by_method = F.when(F.col("mined_rule").isNotNull(), BLOCK).otherwise(ALLOW)
    return own.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("stated", by_method).alias("verdict"), F.when(F.col("stated").isNull(), F.col("mined_rule")).alias("mined_rule"))
