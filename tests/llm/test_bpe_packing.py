from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN, THEIRS = bpe.Bpe(PATH), Tokenizer.from_file(PATH)


def theirs(text: str | None) -> list[int]:
    return THEIRS.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from("aaabbΣ'sß́🎉中<|>\n")), max_size=30), max_size=4))
def test_ids_are_the_librarys(texts):
    assert [i.tolist() for i in OWN.encode_batch(texts)] == [theirs(t) for t in texts]


def test_decoding_is_the_librarys(doc_rows):
    for _, text, *_ in doc_rows:
        ids = next(OWN.encode_batch([text]))
        assert OWN.decode(ids).decode() == THEIRS.decode(ids.tolist(), skip_special_tokens=False)


def test_small_memory_gives_the_same_ids(doc_rows):
    small = bpe.Bpe(PATH, keep=10)
    texts = [t for _, t, *_ in doc_rows]
    assert all(np.array_equal(a, b) for a, b in zip(small.encode_batch(texts), OWN.encode_batch(texts), strict=True))


def test_long_texts_and_chunks_give_the_same_ids(doc_rows, monkeypatch):
    """Texts cut at white space, chunks beyond the hashed length, every white space, and keys that clash."""
    texts = [t for _, t, *_ in doc_rows] + ["x" * 500 + " " + "aé" * 70, "\u2003".join("abcd") * 40, "".join(chr(c) + "w" for c in range(0x3010) if unicodedata.category(chr(c)) != "Cn")]
    want = [theirs(t) for t in texts]
    assert [i.tolist() for i in bpe.Bpe(PATH).encode_batch(texts)] == want
    monkeypatch.setattr(bpe, "ROOM", 300)
    assert [i.tolist() for i in bpe.Bpe(PATH, keep=50).encode_batch(texts)] == want
    plain = bpe.hashes_of
    monkeypatch.setattr(bpe, "hashes_of", lambda *a: (plain(*a)[0] % np.uint64(7), plain(*a)[1]))
    monkeypatch.setattr(bpe, "ROOM", 3000)
    assert [i.tolist() for i in bpe.Bpe(PATH).encode_batch(texts)] == want


def test_query_rows(docs, clashing, none, doc_rows):
    want = sorted((d, len(i := theirs(t)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(THEIRS.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, t, *_ in doc_rows)
    for df in (docs, clashing):
        assert sorted(map(tuple, bpe.encode_digests(df, PATH).collect())) == want
    assert bpe.encode_digests(none, PATH).count() == 0
    row = bpe.encode_documents(docs.where("doc_id = 0"), PATH).first()
    assert row["ids"] == theirs(doc_rows[0][1])


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packs_every_piece_once(docs, clashing, none, doc_rows):
    for df in (docs, clashing):
        rows = packing.pack_documents(df, PATH).collect()
        n = check_places(rows, 4096)
        assert n == -(-sum(r["length"] for r in rows) // 4096)
        want = []
        for d, t, *_ in doc_rows:
            ids = np.array([*theirs(t), 1], "<u4")
            want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert packing.pack_documents(none, PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_all_pieces_and_swap(seed):
    rng = random.Random(seed)
    counts = np.zeros(101, np.int64)
    for _ in range(rng.randint(1, 3000)):
        counts[rng.choice([rng.randint(1, 100), rng.randint(1, 20), 37, 51])] += 1
    left, sequences = counts.copy(), 0
    for times, items in packing.plan_patterns(counts):
        assert sum(n * k for n, k in items.items()) <= 100
        for n, k in items.items():
            left[n] -= times * k
        sequences += times
    assert not left.any()
    assert sequences >= -(-(counts * np.arange(101)).sum() // 100)


def test_two_smaller_documents_replace_the_smallest():
    # Greedy takes 60 and 35 and leaves 5; 20 and 19 fill 39 of the 40 that opens without the 35.
    counts = np.zeros(101, np.int64)
    counts[[60, 35, 20, 19]] = 1
    assert packing.plan_patterns(counts)[0] == (1, {60: 1, 20: 1, 19: 1})
