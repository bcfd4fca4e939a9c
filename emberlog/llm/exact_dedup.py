"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a polynomial at two fixed points modulo two primes,
with its length. Chunks are hashed side by side and combine by shifting the left one by the length
of the right one: F(ab) = F(a) * B^len(b) + F(b). Texts of equal fingerprints are compared chunk by
chunk with the text of the row that stays; should a fingerprint ever stand for unlike texts, its
rows are regrouped by SHA-256. Only a few numbers per text are shuffled, and besides them the
texts of groups of two and more.

Null counts as empty, and empty texts are equal. Of equal texts the row with the largest id stays;
rows repeated with their id all count in group_size and carry the same verdict. Rows whose id is null
form groups like others but stay only if no other row of the group has an id. Columns of docs may have any
names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import freed, held, split_off, stored, thin_out

CHUNK = 1 << 16
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_540_483_477)
#: A group's members are compared in parts of about so many rows, each with its own copy of the text that stays.
PART_ROWS = 256


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for k in range(1, n):
        out[k] = out[k - 1] * base % prime
    return out[::-1].copy()


class Fingerprinter:
    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk
        self.powers = [_powers(b, p, chunk) for b, p in zip(BASES, PRIMES, strict=True)]

    def of_chunks(self, data: bytes) -> list[tuple[int, int, int]]:
        """(first, second, length) of each chunk of data; whole chunks are hashed at once."""
        raw = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        whole = len(raw) // self.chunk
        out = []
        if whole:
            block = raw[: whole * self.chunk].reshape(whole, self.chunk)
            a, b = (block @ w % p for w, p in zip(self.powers, PRIMES, strict=True))
            out = [(int(x), int(y), self.chunk) for x, y in zip(a, b, strict=True)]
        rest = raw[whole * self.chunk :]
        if len(rest):
            a, b = (int(rest @ w[-len(rest) :] % p) for w, p in zip(self.powers, PRIMES, strict=True))
            out.append((a, b, len(rest)))
        return out

    def of(self, data: bytes) -> tuple[int, int, int]:
        return reduce(combine, self.of_chunks(data), (0, 0, 0))


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of left's bytes followed by right's."""
    n = right[2]
    a, b = ((x * pow(base, n, p) + y) % p for x, y, base, p in zip(left, right, BASES, PRIMES, strict=False))
    return a, b, left[2] + n


_MADE: dict[int, Fingerprinter] = {}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, f1, f2, n_bytes, sha256) of each row's whole text. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _MADE.setdefault(chunk, None) or Fingerprinter(chunk)
        _MADE[chunk] = own
        for pdf in batches:
            rows = []
            for text in pdf["text"].tolist():
                data = (text or "").encode()
                rows.append((*own.of(data), hashlib.sha256(data).hexdigest()))
            out = pd.DataFrame(rows, columns=["f1", "f2", "n_bytes", "sha256"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    # As text, since pandas holds a column of numbers with a null in doubles.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, f1 long, f2 long, n_bytes long, sha256 string")
    return rows.withColumn("id", F.col("id").cast("long"))


def _parts(docs: DataFrame) -> DataFrame:
    """The rows of (…, text) as rows of at most CHUNK bytes: (…, at, part)."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    wide = docs.withColumn("data", data).withColumn("at", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / CHUNK))))
    return wide.withColumn("part", F.expr(f"substring(data, cast(at * {CHUNK} + 1 as int), {CHUNK})")).drop("data", "text")


def unequal(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, rep): the rows of members (id, rep, n) whose text is not that of the row rep, compared chunk by chunk."""
    texts = thin_out(docs, "id", members, "id")
    salts = F.ceil(F.col("n") / PART_ROWS)
    apart = members.where("id <> rep").withColumn("salt", F.pmod(F.xxhash64("id"), salts))
    theirs = _parts(texts.join(apart, "id").select("rep", "salt", "id", "text"))
    kept = members.where("id = rep").dropDuplicates(["id"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    reps = texts.dropDuplicates(["id"]).withColumnRenamed("id", "rep").join(kept.select("rep", "salt"), "rep")
    own = _parts(reps.select("rep", "salt", "text")).withColumnRenamed("part", "own")
    met = theirs.join(own, ["rep", "salt", "at"], "left")
    return met.groupBy("id", "rep").agg(F.bool_and(F.coalesce(F.col("part") == F.col("own"), F.lit(False))).alias("same")).where("not same").select("id", "rep")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs."""
    marks = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    key = ["f1", "f2", "n_bytes"]
    groups = marks.groupBy(*key).agg(F.max("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = stored(marks.join(groups, key).select("id", "rep", "n"), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wrong = stored(unequal(texts, members), "unequal")
    marks = marks.withColumn("exact", F.lit(""))
    if wrong.limit(1).count():
        # Unlike texts share a fingerprint: their groups go by SHA-256.
        mixed = marks.join(wrong.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select(*key).distinct().withColumn("mixed", F.lit(True))
        marks = marks.join(mixed, key, "left").withColumn("exact", F.when(F.col("mixed"), F.col("sha256")).otherwise("")).drop("mixed")
    key = [*key, "exact"]
    groups = marks.groupBy(*key).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return marks.join(groups, key).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeated with id and text, one.

    Rows without a copy pass without a join. Only groups of two and more meet their verdicts.
    """
    copies = stored(find_copies(docs, id_col, text_col), "copies")
    groups = copies.where("group_size > 1").select(F.col(id_col).alias("member"), "kept", F.col("text_sha256").alias("sha")).distinct()
    rows = held(docs, key=F.col(id_col).cast("long"), mark=F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    may, alone = split_off(rows, "key", groups, "member")
    met = may.join(groups, F.col("key").eqNullSafe(F.col("member")) & (F.col("mark") == F.col("sha")), "left")
    stays = met.where("kept is null").unionAll(met.where("kept").dropDuplicates(["key", "mark"]))
    return freed(alone.select("row").unionAll(stays.select("row")), docs.columns)
