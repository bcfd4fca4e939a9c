"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it.

Features are shares of hashed byte bigrams and trigrams of the lower-cased letters of the whole text.
Both levels use linear support vector machines, one for each pair (of families, or of languages of a
family), trained by dual coordinate descent on a bounded sample of labelled documents: at most
`per_language` of each language and `most` in all (or five of each, if that is more). A prediction is a mean of weights over the
text's n-grams, so a text of any length is read once, in one pass without a shuffle.

A text that is null or has no letter gets `und` with score 0. Where nothing is learned (an empty
table, no labels) every row gets `und`. Ties in votes go to the larger sum of margins, then to the
name that sorts first. Repeated rows are judged each for itself. predict() adds lang_pred and score to docs
and replaces columns of these names; identify() and the pipeline's stage put columns of any names aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Families of common languages by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "ar he mt",
    "indic": "bn gu hi mr ne pa ur",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
SIZE = 1 << 14
BIGRAMS = 1 << 12
GROUP_BYTES = 1 << 18

_LETTER = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def ngrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, positions) of the n-grams of letters (lower-case bytes, other bytes 32) that hold a word's inside."""
    b = data.astype(np.uint32)
    two = ((b[:-1] * 0x9E3779B1 + b[1:] * 0x85EBCA6B) & 0xFFFFFFFF) >> 20
    three = ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0xC2B2AE35 + b[2:] * 0x27D4EB2F) & 0xFFFFFFFF) >> 10
    three = BIGRAMS + three % (SIZE - BIGRAMS)
    p2 = np.flatnonzero((data[:-1] != 32) & (data[1:] != 32))
    p3 = np.flatnonzero(data[1:-1] != 32)
    return np.concatenate([two[p2], three[p3]]).astype(np.int32), np.concatenate([p2, p3])


def letters(text: str | None) -> bytes:
    """The lower-case letters of text, runs of anything else being a space; empty if it has no letter."""
    if not text:
        return b""
    low = text.lower()
    if not low.isascii():
        if not any(map(str.isalpha, low)):
            return b""
    out = _LETTER[np.frombuffer(low.encode(), np.uint8)]
    return out.tobytes() if (out != 32).any() else b""


def _train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 30, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear SVM (hinge loss, dual coordinate descent) for rows (codes, values) and y of -1 and 1: (weights, bias)."""
    norm = [float(v @ v) + 1 for _, v in x]
    w, bias, alpha = np.zeros(SIZE, np.float32), 0.0, np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            at, v = x[i]
            grad = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - grad / norm[i], 0), c)
            if new != alpha[i]:
                w[at] += np.float32((new - alpha[i]) * y[i]) * v
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


class Model:
    """Pairs of families and pairs of languages within each, with one weight column for each pair."""

    def __init__(self, x: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        """x: the n-gram codes of each text, each once, and their shares."""
        self.langs = sorted(set(langs))
        family = {n: FAMILY_OF.get(n, n) for n in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [n for n in self.langs if family[n] == f] for f in self.families}
        own = np.array(langs)
        of = np.array([family[n] for n in langs])
        self.scale = 1 / max(1e-9, float(np.sqrt(np.mean([float(v @ v) for _, v in x]))))
        x = [(at, v * np.float32(self.scale)) for at, v in x]
        self.pairs, weights, bias = [], [], []
        for level, names, is_ in [("", self.families, of), *((f, m, own) for f, m in self.members.items())]:
            for a, b in combinations(names, 2):
                rows = np.flatnonzero((is_ == a) | (is_ == b))
                w, b0 = _train([x[k] for k in rows], np.where(is_[rows] == a, 1.0, -1.0))
                self.pairs.append((level, a, b))
                weights.append(w * np.float32(self.scale))
                bias.append(b0)
        self.weights = np.array(weights, np.float32).T.copy() if weights else np.zeros((SIZE, 0), np.float32)
        self.bias = np.array(bias)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """One row for each non-empty text of letters(), one column for each pair."""
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        data = np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)
        codes, at = ngrams(data)
        doc = np.repeat(np.arange(len(texts)), size)[at]
        n = np.maximum(1, np.bincount(doc, minlength=len(texts)))
        out = np.empty((len(texts), len(self.pairs)))
        for k in range(len(self.pairs)):
            out[:, k] = np.bincount(doc, self.weights[:, k][codes], len(texts)) / n + self.bias[k]
        return out

    def _vote(self, level: str, names: list[str], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes, sums = np.zeros((len(m), len(names))), np.zeros((len(m), len(names)))
        for k, (at, a, b) in enumerate(self.pairs):
            if at == level and a in names and b in names:
                for name, sign in ((a, 1), (b, -1)):
                    votes[:, names.index(name)] += sign * m[:, k] > 0
                    sums[:, names.index(name)] += sign * m[:, k]
        best = np.argmax(votes + 0.5 / (1 + np.exp(-np.clip(sums, -30, 30))), 1)
        sure = np.ones(len(m))
        for k, (at, a, b) in enumerate(self.pairs):
            if at == level and a in names and b in names:
                for name, sign in ((a, 1), (b, -1)):
                    on = best == names.index(name)
                    sure[on] = np.minimum(sure[on], 1 / (1 + np.exp(-np.clip(2 * sign * m[on, k], -30, 30))))
        return best, sure

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        m = self.margins(texts)
        top, sure = self._vote("", self.families, m)
        names, score = np.empty(len(texts), object), np.array(sure)
        for k, family in enumerate(self.families):
            on = np.flatnonzero(top == k)
            if len(on):
                own, inner = self._vote(family, self.members[family], m[on])
                names[on] = np.array(self.members[family], object)[own]
                score[on] *= inner
        return names.tolist(), score


def fit(labelled: DataFrame, per_language: int = 300, most: int = 3000) -> Model | None:
    """A model of labelled (key, text, lang), rows with a null being left out. Sampled by a hash of key, whole texts.

    No language goes without its share: five documents of each are taken even if that makes more than `most`.
    """
    labelled = labelled.where("key is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    want = max(5, min(per_language, most // len(counts)))
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(min(1.0, 1.5 * want / n + 20 / n) * (1 << 30))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, lang, text in zip(pdf["draw"], pdf["lang"], pdf["text"], strict=True):
                data = letters(text)
                if data:
                    codes, _ = ngrams(np.frombuffer(b"  " + data + b"  ", np.uint8))
                    i, n = np.unique(codes, return_counts=True)
                    rows.append((key, lang, i.astype(np.uint16).tobytes(), (n / n.sum()).astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["draw", "lang", "i", "x"])

    sample = labelled.where(wanted).select(draw.alias("draw"), "lang", "text").mapInPandas(run, "draw long, lang string, i binary, x binary")
    # The smallest draws within each language: a frequent one's are all small, a rare one's are spread over the range.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "i", "x"))
    taken = sample.withColumn("place", place).where(F.col("place") <= want).collect()
    rows = sorted(taken, key=lambda r: (r["lang"], r["place"]))
    if not rows:
        return None
    x = [(np.frombuffer(bytes(r["i"]), np.uint16), np.frombuffer(bytes(r["x"]), np.float32)) for r in rows]
    return Model(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; other columns pass through and are not looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        group: list[bytes] = []
        at: list[int] = []
        room = 0

        def flush() -> None:
            if group and sent.value:
                got, sure = sent.value.predict(group)
                names[at] = got
                score[at] = sure

        for k, text in enumerate(texts.tolist()):
            data = letters(text)
            if data:
                group.append(data)
                at.append(k)
                room += len(data)
            if room > GROUP_BYTES:
                flush()
                group, at, room = [], [], 0
        flush()
        return pd.DataFrame({"lang_pred": names, "score": score})

    # Not to be copied into a filter on its result: texts are read once.
    found = run.asNondeterministic()(F.col(text_col))
    return docs.withColumn("_language", found).withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")


def has_letters(text_col: str = "text") -> Column:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(letters(t)) for t in texts.tolist()], dtype=bool)

    return run(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the documents that are not held out."""
    known = docs.where(~held_out(id_col)).select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return fit(known)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every document."""
    model = fit_documents(docs, id_col, text_col, lang_col)
    return predict(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
