from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, lang: str = "en") -> str:
    parts = {"en": ["the", "ing", "ash", "tion", "er", "wh", "on"], "de": ["sch", "ung", "ein", "ver", "keit", "ü", "au"], "fr": ["eau", "tion", "é", "ou", "elle", "aux", "qu"], "es": ["ción", "ado", "ñ", "os", "ll", "ez", "ar"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def rows() -> list[tuple]:
    """Documents with everything that may go wrong: nulls, empty and very long texts, copies, near copies, shared passages, secrets."""
    rng = random.Random(3)
    out = []
    for k in range(120):
        lang = ["en", "de", "fr", "es"][k % 4]
        out.append([k, prose(rng, rng.randint(20, 200), lang), lang if k % 7 else None, f"src{k % 3}"])
    passage = prose(rng, 80)
    for k in range(0, 20, 2):
        out[k][1] += " " + passage
    near = prose(rng, 150).split()
    for k in range(120, 140):
        words = list(near)
        words[rng.randrange(150)] = "changed" + str(k % 5)
        out.append([k, " ".join(words), "en", "hot"])
    for k in range(140, 170):
        out.append([k, "the same text again and again", "en", "hot"])
    out += [[170, None, "en", "a"], [171, "", None, None], [172, "  \n ", "de", "a"], [173, "12345 !!! ---", "en", "b"], [174, prose(rng, 9000), "en", "b"], [175, "one two", "en", None], [176, "one two", "en", None]]
    out += [[177, 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "en", "c"], [178, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixes it", "en", "c"], [179, "naïve 🎉 Σίσυφος x<|endoftext|>y\x1cz", "fr", "c"]]
    out += [[180, "repeated row of a document", "en", "d"]] * 2
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def doc_rows() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["id", "u", "data", "rep", "n", "key", "sketch", "piece", "length", "bucket", "rank", "h", "g", "size", "lang_pred", "score", "_found", "copies", "comp", "at", "part", "mark", "sha", "member", "place", "_language", "gone", "_gone", "_key", "_id", "_kept", "_mark", "_sha", "row", "_path", "_gaps", "class_id", "kept"]
    return docs.withColumns({n: F.lit("x") for n in names})
