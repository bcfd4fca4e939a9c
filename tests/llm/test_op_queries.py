"""Every op query over whole driver tables, against brute force written for the contract alone."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_dedup import brute_links, brute_repeats
from tokenizers import Tokenizer

from emberlog.llm import queries, url_filter

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(name: str, columns: str, d: str = DATA) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{d}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    return rows("documents", "doc_id, text, lang")


def result(spark, name: str, columns: str, d: str = DATA) -> list[tuple]:
    return [tuple(r) for r in queries.QUERIES[name](spark, d).select(*columns.split()).collect()]


def test_op1(spark, documents):
    tok = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    places = defaultdict(list)
    for doc, piece, start, length, crc, seq, offset in result(spark, "op1_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset"):
        got[doc].append((piece, start, length, crc))
        places[seq].append((offset, length))
    for doc, text, _ in documents:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(got[doc]) == want
    total = 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(places) <= -(-total // 4096) * 1.05 + 1


def test_op2(spark, documents):
    assert {d: (c, n) for d, c, n in result(spark, "op2_jaccard_join", "doc_id class_id n_links")} == brute_links(documents)


def brute_rules(labelled: list[tuple[frozenset, bool]], support: float, confidence: float, least: int) -> set[frozenset]:
    """All minimal token combinations of enough support and confidence, by counting every combination of frequent tokens."""
    floor = max(support * len(labelled), least)
    bad = Counter(t for tokens, is_bad in labelled if is_bad for t in tokens)
    common = {t for t, n in bad.items() if n >= floor}
    every, hits = Counter(), Counter()
    for tokens, is_bad in labelled:
        own = sorted(tokens & common)
        for k in range(1, len(own) + 1):
            for c in combinations(own, k):
                every[c] += 1
                hits[c] += is_bad
    found = {frozenset(c) for c, n in hits.items() if n >= floor and n >= confidence * every[c]}
    return {c for c in found if not any(o < c for o in found)}


def test_mining_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    words = list("abcdefgh")
    labelled = []
    for _ in range(400):
        tokens = frozenset(rng.choice(words, rng.integers(1, 6), replace=False).tolist())
        labelled.append((tokens, bool({"a", "b"} <= tokens or "c" in tokens and rng.random() < 0.97 or rng.random() < 0.02)))
    df = spark.createDataFrame([(sorted(t), b) for t, b in labelled], "tokens array<string>, bad boolean")
    got = {frozenset(r) for r in url_filter.mine(df, 0.02, 0.9, 5)}
    assert got == brute_rules(labelled, 0.02, 0.9, 5) and frozenset("c") in got and frozenset("ab") in got


def test_op3(spark):
    """Rules, labels and mining from scratch; on the larger tables there is something to mine."""
    for d in (DATA, "/root/testdata/sf0.1"):
        toxic = dict(rows("labels", "doc_id, toxic", d))
        pages, labelled = [], []
        for page, url in rows("pages", "page_id, url", d):
            rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
            path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
            word = "".join(c if c.isalpha() or c.isnumeric() else " " for c in f"{host}/{path}".lower()).split()
            tokens = frozenset(w for w in word if not w.isnumeric())
            pages.append((page, host, path, tokens))
            labelled.append((tokens, toxic.get(page) == 1 or bool(tokens & set(queries.BAD_WORDS))))
        mined = brute_rules(labelled, 0.002, 0.9, 10)
        want = {}
        for page, host, path, tokens in pages:
            fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            rule, verdict = max(fits)[1:] if fits else (None, "block" if any(m <= tokens for m in mined) else "allow")
            want[page] = (host, path, rule, verdict)
        assert {p: tuple(r) for p, *r in result(spark, "op3_url_filter", "page_id host path rule verdict", d)} == want
    assert mined


def test_op4(spark):
    vectors = {i: np.array(v, float) for i, v in rows("embeddings", "vec_id, embedding") if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    got = defaultdict(list)
    for q, rank, i, score in result(spark, "op4_nearest", "query_id rank vec_id score"):
        got[q].append((rank, i, score))
    assert set(got) == {i for i in vectors if i % 100 == 0}
    found = wanted = 0
    for q, own in got.items():
        exact = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, min(10, len(exact)) + 1))
        assert own == sorted(own, key=lambda x: (x[2], x[1])) or np.allclose([s for _, _, s in own], sorted(s for _, _, s in own))
        scores = {i: s for s, i in exact}
        assert all(abs(scores[i] - s) < 1e-9 for _, i, s in own)
        found += len({i for _, i, _ in own} & {i for _, i in exact[:10]})
        wanted += len(exact[:10])
    assert found >= 0.9 * wanted


def test_op5(spark, documents):
    """Each finding is where it says, and secrets in the tables' own forms are found, though the forest never saw these documents."""
    texts = {d: t for d, t, _ in documents}
    got = defaultdict(set)
    for doc, start, length, value in result(spark, "op5_secret_scan", "doc_id start length value"):
        assert texts[doc][start : start + length] == value
        got[doc].add(value)
    import re

    plain = re.compile(r"AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|(?:password|api_key|secret|token)\s*[=:]\s*\"?([0-9a-f]{32,})")
    want = {(d, m[1] or m[0]) for d, t in texts.items() if t for m in plain.finditer(t)}
    missed = [(d, v) for d, v in want if not any(v in g or g in v for g in got[d])]
    assert len(missed) <= 0.05 * len(want)


def test_op6(spark, documents):
    by = defaultdict(list)
    for d, t, _ in documents:
        by[t or ""].append(d)
    want = sorted((d, max(by[t or ""]), len(by[t or ""]), d == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in documents)
    assert sorted(result(spark, "op6_exact_dedup", "doc_id keep_id group_size kept text_sha256")) == want


def test_op7(spark, documents):
    texts = {d: (t, lang) for d, t, lang in documents}
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    learned = {lang for d, (t, lang) in texts.items() if lang is not None and not held(d)}
    right = known = 0
    got = result(spark, "op7_language_id", "doc_id held_out lang_pred score")
    assert sorted(r[0] for r in got) == sorted(texts)
    for doc, is_held, pred, score in got:
        text, lang = texts[doc]
        assert is_held == held(doc) and 0 <= score <= 1
        assert (pred == "und") == (not any(map(str.isalpha, text or ""))) and pred in learned | {"und"}
        if is_held and lang is not None and pred != "und":
            known += 1
            right += pred == lang
    assert known and right >= 0.95 * known


def test_op8(spark, documents):
    want = sorted((d, *b) for (d, *_), b in zip(documents, brute_repeats([(t or "").encode() for _, t, _ in documents]), strict=True))
    assert sorted(result(spark, "op8_suffix_dedup", "doc_id n_bytes n_removed n_spans kept_sha256")) == want


def test_op9(spark, documents):
    tok = Tokenizer.from_file(PATH)
    want = []
    for d, t, _ in documents:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(result(spark, "op9_bpe", "doc_id n_tokens ids_sha256 decoded_sha256")) == sorted(want)


def test_op10(spark, documents):
    got = result(spark, "op10_sharding", "doc_id size text_crc32 law shard slot grown_shard")
    size = {d: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in documents}
    assert {d: (n, c) for d, n, c, *_ in got} == size and len(got) == len(documents)
    shards = defaultdict(list)
    for _, n, _, law, shard, slot, grown in got:
        assert law == "bytes" and 0 <= shard < 40 and grown is None
        shards[shard].append((slot, n))
    for own in shards.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    # No shard is further from its share than the largest text.
    share, largest = sum(n for n, _ in size.values()) / 40, max(n for n, _ in size.values())
    assert all(abs(sum(n for _, n in shards.get(k, [])) - share) <= largest + share * 0.01 for k in range(40))
