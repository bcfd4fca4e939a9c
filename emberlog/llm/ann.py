"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional codeword from each of several codebooks, which are
trained one after the other on residuals of a bounded sample. Encoding keeps a beam of the best
partial sums. The index holds every vector's codes and the squared norm of its reconstruction; a
query's distance to it is then a sum of table lookups. The nearest by that measure are ranked anew
by exact distance in double precision.

Vectors that are null, zero, of another length than most, or with a null or non-finite component take
no part. Of identical vectors only as many as could be returned are looked at, smallest ids first,
which loses no answer. Ties go to the smaller id. Each task keeps its best rows per query, and
these meet in one aggregate; queries are sent out in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import stored

BOOKS = 8
WORDS = 256
BEAM = 8
SAMPLE = 8192
RERANK = 200
QUERY_BLOCK = 4096


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.where(F.coalesce(fine, F.lit(False)))
    most = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return own.where(F.size("v") == (most[0]["n"] if most else 0))


class Codebooks:
    """books: (books, words, dimensions). Trained by k-means on the residuals of a sample."""

    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 12):
        rng = np.random.default_rng(11)
        rest = sample.astype(np.float32).copy()
        made = []
        for _ in range(books):
            c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
            for _ in range(rounds):
                near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)
                n = np.bincount(near, minlength=words)
                order = np.argsort(near, kind="stable")
                full = np.flatnonzero(n)
                sums = np.add.reduceat(rest[order], (np.cumsum(n) - n)[full], axis=0)
                c[full] = sums / n[full, None]
            made.append(c)
            rest -= c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)]
        self.books = np.array(made)
        flat = self.books.reshape(-1, self.books.shape[2])
        self.gram = (flat @ flat.T).reshape(books, words, books, words)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The codes (n, books) of the best sum found with a beam."""
        n = len(x)
        m_all, words = self.books.shape[:2]
        codes = np.zeros((n, 1, 0), np.int64)
        err = np.zeros((n, 1), np.float32)
        rows = np.arange(n)[:, None]
        for m in range(m_all):
            gain = (self.books[m] ** 2).sum(1) - 2 * x @ self.books[m].T
            score = err[:, :, None] + gain[:, None, :]
            for k in range(m):
                score += 2 * self.gram[k, :, m, :][codes[:, :, k]]
            flat = score.reshape(n, -1)
            keep = min(beam if m + 1 < m_all else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            err = flat[rows, best]
            codes = np.concatenate([codes[rows, best // words], (best % words)[:, :, None]], 2)
        return codes[:, 0].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Codebooks | None:
    """Codebooks from at most `sample` vectors, drawn by a hash of their id."""
    rows = vectors.count()
    if not rows:
        return None
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = vectors.where(draw < int(min(1.0, 1.2 * sample / rows) * (1 << 30))).limit(sample).select("v").toPandas()["v"]
    if not len(some):
        some = vectors.limit(sample).select("v").toPandas()["v"]
    return Codebooks(np.stack(some.to_numpy()))


def index(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, v, codes, norm) of every row of clean()."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                codes = sent.value.encode(np.stack(part["v"].to_numpy()).astype(np.float32))
                norm = (sent.value.decode(codes).astype(np.float64) ** 2).sum(1)
                yield part.assign(codes=[c.tobytes() for c in codes], norm=norm)

    return vectors.mapInPandas(run, "id long, v array<float>, codes binary, norm double")


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, dist))[:k]


def search(indexed: DataFrame, books: Codebooks, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int = RERANK) -> DataFrame:
    """(query_id, id, score): each task's k nearest for each of a block of queries."""
    sent = indexed.sparkSession.sparkContext.broadcast((books.books, query_ids, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q_ids, q = sent.value
        tables = np.einsum("qd,mkd->mqk", q.astype(np.float32), own)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q_ids)
        for whole in batches:
            for at in range(0, len(whole), 8192):
                pdf = whole.iloc[at : at + 8192].sort_values("id")
                ids, v = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.float32)
                raw = np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
                _, group = np.unique(raw, return_inverse=True)
                order = np.argsort(group, kind="stable")
                first = np.r_[True, group[order][1:] != group[order][:-1]]
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                keep = np.sort(order[place <= k])
                ids, v = ids[keep], v[keep]
                codes = np.frombuffer(b"".join(pdf["codes"].to_numpy()[keep]), np.uint8).reshape(len(ids), -1)
                norm = pdf["norm"].to_numpy()[keep].astype(np.float32)
                exact = v.astype(np.float64)
                for lo in range(0, len(q_ids), 256):
                    score = norm - 2 * sum(tables[m, lo : lo + 256][:, codes[:, m]] for m in range(len(own)))
                    for j in range(len(score)):
                        i = lo + j
                        near = np.argpartition(score[j], rerank)[:rerank] if len(ids) > rerank else np.arange(len(ids))
                        near = near[ids[near] != q_ids[i]]
                        dist = np.sqrt(((exact[near] - q[i]) ** 2).sum(1))
                        dist, found = np.concatenate([best[i][0], dist]), np.concatenate([best[i][1], ids[near]])
                        top = _best(dist, found, k)
                        best[i] = dist[top], found[top]
        for i, (dist, found) in enumerate(best):
            if len(dist):
                yield pd.DataFrame({"query_id": q_ids[i], "id": found, "score": dist})

    return indexed.mapInPandas(run, "query_id long, id long, score double")


def nearest(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of each row for which is_query (a Column over `id`) holds."""
    spark = vectors.sparkSession
    own = clean(vectors, id_col, vector_col)
    books = fit(own)
    if books is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    indexed = stored(index(own, books), "ann-index")
    asked = indexed.where(is_query).select("id", "v")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas().drop_duplicates("id")
        if len(block):
            part = search(indexed, books, block["id"].to_numpy(), np.stack(block["v"].to_numpy()).astype(np.float64), k)
            found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
