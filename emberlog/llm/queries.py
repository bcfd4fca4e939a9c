"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import ann, bpe, exact_dedup, jaccard, language, packing, secrets, sharding, suffix_dedup, url_filter
from emberlog.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 40
# The stated rules, and words of URLs that are known to be bad.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BAD_WORDS = ["ads", "bets", "casino", "pills"]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page is bad if its labels row is toxic or its host or path holds one of BAD_WORDS; any other page is not, with or without a labels row."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic"))
    known = pages.join(toxic, "page_id", "left").withColumns({"host": url_filter.host_of("url"), "path": url_filter.path_of("url")})
    known = known.withColumn("tokens", url_filter.tokens_of("host", "path"))
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.arrays_overlap("tokens", F.array(*map(F.lit, BAD_WORDS)))
    return url_filter.judge(pages, URL_RULES, url_filter.mine(known.select("tokens", bad.alias("bad"))))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that the forest takes for secrets."""
    return secrets.scan(table(spark, sf_dir, "documents")).where("is_secret").drop("is_secret")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_url_filter": op3_url_filter,
    "op4_nearest": op4_nearest,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
}

ORACLE: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)
    """,
}
