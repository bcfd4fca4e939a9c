from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberlog.llm import exact_dedup, jaccard, suffix_dedup


def test_fingerprints_compose():
    own = exact_dedup.Fingerprinter(16)
    data = bytes(range(256)) * 3 + b"tail"
    for cut in (0, 1, 15, 16, 17, 400, len(data)):
        assert exact_dedup.combine(own.of(data[:cut]), own.of(data[cut:])) == own.of(data)
    assert own.of(b"\0") != own.of(b"") and own.of(b"ab") != own.of(b"ba")
    assert own.of(data) == exact_dedup.Fingerprinter(64).of(data)


def brute_copies(rows):
    by = defaultdict(list)
    for d, t, *_ in rows:
        by[t or ""].append(d)
    return sorted((d, max(by[t or ""]), len(by[t or ""]), d == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows)


def test_copies_match_brute_force(docs, clashing, none, doc_rows):
    for df in (docs, clashing):
        assert sorted(map(tuple, exact_dedup.find_copies(df).collect())) == brute_copies(doc_rows)
    assert exact_dedup.find_copies(none).count() == 0
    for df in (docs, clashing):
        kept = exact_dedup.drop_copies(df)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({k for _, k, *_ in brute_copies(doc_rows)})


def test_a_clash_of_fingerprints_is_resolved(spark, monkeypatch):
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "ddd")]
    plain = exact_dedup.fingerprints

    def clashing(docs, *a, **k):
        from pyspark.sql import functions as F

        return plain(docs, *a, **k).withColumns({"f1": F.lit(1).cast("long"), "f2": F.lit(1).cast("long")})

    monkeypatch.setattr(exact_dedup, "fingerprints", clashing)
    got = exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1)}


def test_texts_of_many_chunks_are_compared(spark):
    long = "x" * (3 * exact_dedup.CHUNK)
    df = spark.createDataFrame([(1, long), (2, long), (3, long[:-1] + "y")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.find_copies(df).collect()} == {1: 2, 2: 2, 3: 3}


def brute_links(rows):
    sets, texts = {}, Counter()
    for d, t, *_ in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        texts[d] += 1
    words = {d: " ".join((t or "").lower().split()) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter({d: texts[d] - 1 for d in sets})
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if words[a] == words[b] or (both and both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                links[a] += texts[b]
                links[b] += texts[a]
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in sets}


@pytest.mark.parametrize("limits", [(1024, 2048, 1 << 19), (4, 8, 1000)])
def test_near_duplicates_match_brute_force(docs, clashing, none, doc_rows, limits, monkeypatch):
    """Also with limits so small that buckets meet pivots and are split, and components are compared in blocks."""
    for name, value in zip(("LIMIT", "ROWS", "BUDGET"), limits, strict=True):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.near_duplicates(docs if limits[0] > 4 else clashing).collect()
    assert len(got) == len(doc_rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_links(doc_rows)
    if limits[0] > 4:
        assert jaccard.near_duplicates(none).count() == 0
        kept = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
        assert {r["doc_id"] for r in jaccard.keep_one(clashing).collect()} == kept
        assert kept == {c for c, _ in brute_links(doc_rows).values()}


def near_rows(shape: str) -> list[tuple]:
    """Groups that do not shrink by splitting: variants of one text, texts around one passage, and texts that differ in one word."""
    rng = random.Random(11)
    core = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    out = []
    for k in range(160):
        words = list(core)
        if shape == "variants":
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(160)] = f"v{rng.randrange(10**6)}"
        elif shape == "passage":
            words = [f"a{rng.randrange(10**6)}" for _ in range(rng.randint(5, 200))] + core[:60] + [f"z{rng.randrange(10**6)}" for _ in range(rng.randint(5, 200))]
        else:
            words = words * 6 + [f"end{k % 90}"]
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize("shape", ["variants", "passage", "ends"])
def test_groups_that_do_not_shrink(spark, shape, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 8)
    monkeypatch.setattr(jaccard, "ROWS", 50)
    rows = near_rows(shape)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_links(rows)


def test_overlaps_match_sets(monkeypatch):
    monkeypatch.setattr(jaccard, "DENSE", 4)
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 60, rng.integers(0, 80)).astype(np.uint64) for _ in range(12)]
    n, both = jaccard._overlaps(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert n.tolist() == [len(set(s.tolist())) for s in sets]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    off = ~np.eye(12, dtype=bool)
    assert (both == np.array(want))[off].all()


def test_runs_follow_the_recall():
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.99) < jaccard.runs_for(0.999)


def brute_repeats(texts: list[bytes], w: int = 200):
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i : i + w] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [4096, 3])
def test_repeats_match_brute_force(docs, clashing, none, doc_rows, limit, monkeypatch):
    """Also with a limit so small that groups are halved again and again."""
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    want = sorted((d, *b) for (d, *_), b in zip(doc_rows, brute_repeats([(t or "").encode() for _, t, *_ in doc_rows]), strict=True))
    got = suffix_dedup.remove_repeats(docs if limit > 3 else clashing).drop("kept")
    assert sorted(map(tuple, got.collect())) == want
    if limit > 3:
        assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("limit", [4096, 3])
def test_a_third_document_holds_part_of_a_shared_passage(spark, limit, monkeypatch):
    """Whole in X and Y, in part in Z, at places of their own: no place of one document may be used for another."""
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    rng = np.random.default_rng(5)

    def own(n):
        return bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()

    texts = []
    for _ in range(6):
        passage = own(600)
        texts += [own(5000) + passage + own(900), own(50) + passage + own(900), own(2000) + passage[:400] + own(700)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("kept")
    assert sorted(map(tuple, got.collect())) == [(k, *b) for k, b in enumerate(brute_repeats([t.encode() for t in texts]))]


def test_repeats_inside_one_text(spark):
    texts = ["ab" * 300, "x" * 199, "y" * 200, "y" * 201, "é" * 250, "".join(chr(97 + i * i % 26) for i in range(700)) * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(df).drop("kept").collect()))
    assert got == [(k, *b) for k, b in enumerate(brute_repeats([t.encode() for t in texts]))]


def test_long_texts_go_in_segments(spark, monkeypatch, doc_rows):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    texts = [(t or "").encode() for _, t, *_ in doc_rows]
    small = {i: p.tolist() for i, _, p in suffix_dedup.anchors(texts)}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    assert small == {i: p.tolist() for i, _, p in suffix_dedup.anchors(texts)}


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, 40), dtype=np.uint8)
    rows[50:120, :30] = rows[50, :30]
    rows[120:140] = rows[120]
    group = rng.integers(0, 3, 300)
    order = suffix_dedup.deep_shallow(rows, group, shallow=8)
    keys = [(group[k], rows[k].tobytes()) for k in order]
    assert keys == sorted(keys) and sorted(order) == list(range(300))
    strings = [bytes(r) for r in rows[:60]]
    assert [strings[k] for k in suffix_dedup.blind_trie_order(strings)] == sorted(strings)
