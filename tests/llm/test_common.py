from __future__ import annotations

import random

from pyspark.sql import functions as F

from emberlog.llm import common


def test_components_match_union_find(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(500 - k, 500 - k - 1) for k in range(40)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {k: find(k) for k in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmaps_lose_nothing(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    df = spark.range(5000)
    assert common.thin_out(df, "id", keys, "k").join(keys, F.col("id") == F.col("k"), "left_semi").count() == keys.count()
    may, others = common.split_off(df, "id", keys, "k", 1 << 16)
    assert may.count() + others.count() == 5000 and others.join(keys, F.col("id") == F.col("k"), "left_semi").count() == 0
    assert common.thin_out(df, "id", keys.limit(0), "k").count() == 0
