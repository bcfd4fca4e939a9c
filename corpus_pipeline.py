"""The corpus pipeline: language ID, exact dedup, near-duplicate join, secret scan and packing over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents, and any others that docs has, whatever their names: the stages hold the
row aside and add columns of their own beside it.

Rows repeated with their id and text are one document after the dedup stage. Rows with a null id pass all
stages: the dedup stage keeps one of equal texts, and the near-duplicate stage, which needs ids, keeps them
all. Every stage of an empty table is empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import exact_dedup, jaccard, language, packing, secrets
from emberlog.llm.common import drop_since, drop_stored, freed, held, stored, table, tables_made
from emberlog.shipping import ship

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without letters) go; a missing lang is filled in, or stays if nothing is learned."""
    ship(spark)
    model = language.fit_documents(docs)
    if model is None:
        return docs.where(language.has_letters())
    found = language.predict(held(docs, text=F.col("text"), lang=F.col("lang")), model).where(F.col("lang_pred") != language.UNKNOWN)
    return freed(found, docs.columns, lang=F.coalesce("lang", "lang_pred"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of a similarity of at least 0.8 connect, the one with the smallest doc_id stays."""
    ship(spark)
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text and n_chars follows it; every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Language models, chosen paths and a random forest are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row. What a stage leaves in the shared folder beside its result goes once that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        count, before = tables_made(), docs
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
            drop_since(docs, count)
            drop_stored(before)
    return docs
