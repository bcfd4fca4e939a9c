"""Rows whose id, or every other column, is null: defined results, no crash."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberlog.llm import ann, bpe, exact_dedup, jaccard, language, packing, secrets, sharding, suffix_dedup, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def few(spark):
    rows = [(None, "one text without an id " * 20, "en", "s"), (None, None, None, None), (5, "one text without an id " * 20, "en", None), (2**60 + 1, "a large id", "de", "s"), (7, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def test_every_row_has_a_result(few):
    want = ids(few)
    assert ids(bpe.encode_digests(few, PATH).withColumnRenamed("id", "doc_id")) == want
    assert ids(packing.pack_documents(few, PATH)) == want
    assert ids(exact_dedup.find_copies(few)) == want
    assert ids(language.identify(few)) == want
    assert ids(suffix_dedup.remove_repeats(few)) == want
    assert ids(sharding.shard_by_bytes(few, 3)) == want
    assert ids(secrets.redact(few)) == want
    assert {r["doc_id"] for r in secrets.scan(few).where("is_secret").collect()} == {7}
    # Near duplicates are told by id, so rows without one are left out; keep_one() keeps them.
    assert ids(jaccard.near_duplicates(few)) == [x for x in want if not x[0]]
    assert ids(jaccard.keep_one(few)) == want


def test_null_ids_in_copies(few):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.find_copies(few).collect()}
    assert {(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (2**60 + 1, 2**60 + 1, 1, True)} <= got
    assert ids(exact_dedup.drop_copies(few)) == [(False, 5), (False, 7), (False, 2**60 + 1), (True, 0)]


def test_null_vectors_and_urls(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (100, [1.0, 2.0]), (1, None), (2, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(df, F.col("id") % 100 == 0, 10).collect()] == [(100, 1, 2, 1.0)]
    pages = spark.createDataFrame([(None, None), (1, "http://a.net/")], "page_id long, url string")
    assert sorted((r["verdict"], r["page_id"]) for r in url_filter.judge(pages, [("block", "net", "/")], []).collect()) == [("allow", None), ("block", 1)]
