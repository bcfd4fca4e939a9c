"""N-gram Jaccard self-join by chosen paths: near-duplicate documents by shingles of five words.

A document is the set of its runs of five words (lower-case, split at white space; a text of one to
four words is one shingle). Texts with the same words are copies and are joined as one. Each
class of copies is embedded as 64 minwise values, of which 16 bits each form its sketch; classes of
equal sketches are tied to the smallest of them, which alone goes on. A run of the join splits all
classes into buckets by the value at sampled places, on average 1/0.8 places a bucket, so that a
pair at the threshold survives each split once on average. Buckets of at most LIMIT are compared by
brute force; larger ones are split again, at places sampled for each bucket, until none is left. Runs
are repeated until a pair at the threshold is met with the target recall.

Buckets of much the same texts do not shrink by splitting. So before each split a large bucket is
held against its pivot, its smallest class: all that agree with it at LINK places are tied to it, and what
agrees at HOLD goes no further. HOLD lies so far above LINK that a class which agrees at AGREE places with
one that goes no further is tied to the pivot as well (agreements obey the triangle inequality), so
nothing is lost; and a bucket that is tied to its pivot as a whole is done. All this costs each row
of a bucket one comparison a split, never the pairs.

Sketches that agree well enough join their classes into candidate components. Inside a component all
pairs are compared exactly, on their whole texts, so a link that the runs miss is still found through
any third text, and the number of links is exact. A component of more than BUDGET shingles or ROWS classes
is dealt over blocks, each pair of which meets in a task; only counts and a spanning forest leave it.

Null counts as empty. Texts without words are copies of one another and have no other links. Rows repeated
with their id count as copies. Documents need ids; rows with a null id are left out. Columns of docs may have
any names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import components, drop_stored, freed, held, split_off, stored, thin_out

WORDS = 5
THRESHOLD = (4, 5)
PLACES = 64
LIMIT = 1024
#: Splits after which runs still meet a pair at the threshold with the target recall: LIMIT * 2^DEPTH rows at a similarity of a half.
DEPTH = 4
#: Shingles and classes of one block in the exact comparison.
BUDGET = 1 << 19
ROWS = 2048
RECALL = 0.999
#: A bucket is split at one place, and at a second one with this chance: 1.25 places, the inverse of the threshold.
SECOND = 0.25
#: Agreeing places below which a pair at the threshold lies with a chance of less than 1 in 10,000.
AGREE = 38
#: Agreeing places from which a class needs no comparison beside its pivot's, and from which it is tied to its pivot.
HOLD = 54
LINK = HOLD - (PLACES - AGREE)

_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, WORDS)]
_A = _rng.integers(0, 2**64, PLACES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, PLACES, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingle hashes of texts of normal(), one after the other, with repeats."""
    b = np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8)
    up, down = _power(len(b) + 1)
    sep = (b == 32) | (b == 10)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[:-1], out=sums[1:])
    start = np.flatnonzero(~sep & np.r_[True, sep[:-1]])
    end = np.flatnonzero(sep & np.r_[False, ~sep[:-1]])
    word = _mix((sums[end] - sums[start]) * down[start])
    doc = np.searchsorted(np.flatnonzero(b == 10), start)
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    size = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    word = np.r_[word, np.zeros(WORDS, np.uint64)]
    there = np.repeat(np.minimum(n_words, WORDS), size)
    out = there.astype(np.uint64)
    for k in range(WORDS):
        out += np.where(k < there, word[at + k] * _STEP[k], np.uint64(0))
    return _mix(out), size


def minima(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(texts, PLACES) minwise values of 64 bits; texts must have shingles."""
    at = np.cumsum(size) - size
    out = np.empty((len(size), PLACES), np.uint64)
    for k in range(PLACES):
        out[:, k] = np.minimum.reduceat(hashes * _A[k] + _B[k], at)
    return _mix(out)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """(id, c1, c2, size, sketch, roots): a 128-bit key of the text's words, the number of its shingles, its sketch,
    and its whole values at the places where runs begin (null without words). No shuffle."""
    first = [place for r in range(runs_for(recall)) for place in _roots(r)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["text"].tolist()
            at = 0
            while at < len(texts):
                group, room, begin = [], 0, at
                while at < len(texts) and room < 1 << 20:
                    group.append(normal(texts[at]))
                    room += len(group[-1])
                    at += 1
                keys = np.frombuffer(b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in group), "<i8").reshape(-1, 2)
                hashes, size = shingles(group)
                has = size > 0
                low = minima(hashes, size[has]) if has.any() else np.zeros((0, PLACES), np.uint64)
                marks, roots = iter((low >> np.uint64(48)).astype(np.uint16)), iter(low[:, first])
                sketch, root = ([next(of).tobytes() if h else None for h in has] for of in (marks, roots))
                yield pd.DataFrame({"id": ids[begin:at], "c1": keys[:, 0], "c2": keys[:, 1], "size": size, "sketch": sketch, "roots": root})

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return own.mapInPandas(run, "id long, c1 long, c2 long, size long, sketch binary, roots binary")


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is met with this chance.

    A run is a branching process: each split has a place, and a second one with the chance SECOND, which the pair
    shares with a chance of the threshold. `gone` is the chance that no branch is left after the first split
    and `depth` more.
    """
    share, gone = THRESHOLD[0] / THRESHOLD[1], 0.0
    for _ in range(depth + 1):
        lost = 1 - share + share * gone
        gone = lost * (1 - SECOND + SECOND * lost)
    return math.ceil(math.log(1 - recall) / math.log(gone))


def _roots(run: int) -> list[int]:
    """The places at which run splits all classes: one, and a second in one run of four."""
    rng = np.random.default_rng(1000 + run)
    return rng.permutation(PLACES)[: 1 + (run % 4 == 3)].tolist()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), PLACES)


def _first_split(reps: DataFrame) -> DataFrame:
    """(key, rep): the buckets of all runs' first splits, by values of 64 bits, so that chance makes none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            roots = np.frombuffer(b"".join(pdf["roots"]), np.uint64).reshape(len(pdf), -1)
            for k in range(roots.shape[1]):
                yield pd.DataFrame({"key": _mix(roots[:, k] + np.uint64(k + 1)).astype(np.int64), "rep": pdf["rep"]})

    return reps.select("rep", "roots").mapInPandas(run, "key long, rep long")


def _against_pivots(rows: DataFrame) -> DataFrame:
    """(key, rep, sketch, pivot, agree) of rows (key, rep, sketch, pivot, head): the places at which a sketch agrees with the pivot's."""

    @F.pandas_udf("int")
    def agree(sketch: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series((_matrix(sketch) == _matrix(head)).sum(1).astype(np.int32))

    return rows.withColumn("agree", agree("sketch", "head")).drop("head")


def _split(rows: DataFrame) -> DataFrame:
    """Large buckets (key, rep, sketch) into smaller ones, at places sampled for each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            s, rep = _matrix(pdf["sketch"]).astype(np.uint64), pdf["rep"].to_numpy()
            key = pdf["key"].to_numpy().astype(np.uint64)
            for child in range(2):
                draw = _mix(key + np.uint64(child + 77))
                on = np.flatnonzero(draw % np.uint64(4) == 0) if child else np.arange(len(key))
                place = ((draw >> np.uint64(8)) % np.uint64(PLACES)).astype(np.int64)
                new = _mix(key ^ _mix(s[np.arange(len(key)), place] + np.uint64((child + 1) << 32) + (place.astype(np.uint64) << np.uint64(20))))
                yield pd.DataFrame({"key": new[on].astype(np.int64), "rep": rep[on]})

    return rows.mapInPandas(run, "key long, rep long")


def _by_key(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by names, cut so that no key is divided."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for n in names:
            last &= (pdf[n] == pdf[n].iloc[-1]).to_numpy()
        cut = int(np.argmax(last))
        rest = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _small_buckets(rows: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of agreeing sketches in each of the buckets of (key, rep, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_key(batches, ["key"]):
            key, rep, s = pdf["key"].to_numpy(), pdf["rep"].to_numpy(), _matrix(pdf["sketch"])
            found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, LIMIT):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                for lo in range(0, len(i), 1 << 14):
                    j = i[lo : lo + (1 << 14)]
                    j = j[(s[j] == s[j + d]).sum(1) >= AGREE]
                    found[0].append(j)
                    found[1].append(j + d)
            i, j = map(np.concatenate, found)
            label = np.arange(len(rep))
            while (label[i] != label[j]).any():
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                label = label[label]
            on = label != np.arange(len(rep))
            pairs = np.unique(np.sort(np.stack([rep[on], rep[label[on]]], 1), 1), axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def _forest(rep: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The smallest rep of each row's component in a symmetric boolean matrix."""
    label = rep.copy()
    while True:
        low = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            return label
        label = low


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b): links between classes (rep, sketch, roots) whose sketches agree, enough to connect them all."""
    reps = reps.where("sketch is not null")
    heads = reps.groupBy("sketch").agg(F.min("rep").alias("head"), F.min_by("roots", "rep").alias("roots"), F.count("*").alias("n"))
    heads = stored(heads, "heads")
    equal = heads.where("n > 1").select("sketch", "head")
    edges = [reps.join(equal, "sketch").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))]
    marks = heads.select(F.col("head").alias("rep"), "sketch")
    live = _first_split(heads.select(F.col("head").alias("rep"), "roots"))
    done = []
    while True:
        live = stored(live, "paths")
        full = live.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
        sized = stored(live.join(full, "key").join(marks, "rep"), "buckets")
        drop_stored(live)
        done.append(sized)
        edges.append(_small_buckets(sized.where(F.col("n") <= LIMIT).select("key", "rep", "sketch")))
        large = sized.where(F.col("n") > LIMIT).drop("n")
        if not large.limit(1).count():
            break
        against = stored(_against_pivots(large.join(large.where("rep = pivot").select("key", F.col("sketch").alias("head")), "key")), "against")
        done.append(against)
        edges.append(against.where((F.col("agree") >= LINK) & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        loose = against.where(F.col("agree") < LINK).select("key").distinct()
        live = _split(against.where(F.col("agree") < HOLD).join(loose, "key", "left_semi").select("key", "rep", "sketch"))
    out = stored(reduce(DataFrame.unionAll, edges), "candidates")
    for df in (*done, heads):
        drop_stored(df)
    return out


def _cells(rows: DataFrame) -> DataFrame:
    """rows (comp, rep, blocks, …) once for each pair of blocks of their component: adds lo, hi and own (the row's block)."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return out.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")


#: Shingles that more texts of a cell share than this are counted by matrix products, others pair by pair.
DENSE = 32


def _overlaps(hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different shingles of each text, shingles that each two texts share) of texts' shingle hashes."""
    rows = len(size)
    doc = np.repeat(np.arange(rows), size)
    order = np.lexsort((doc, hashes))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]
    hashes, doc = hashes[new], doc[new]
    n = np.bincount(doc, minlength=rows)
    start = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
    col = np.cumsum(start) - 1
    there = np.bincount(col)[col]
    both = np.zeros((rows, rows), np.int32)
    few = (there > 1) & (there <= DENSE)
    c, d = col[few], doc[few]
    for step in range(1, min(DENSE, len(c))):
        i = np.flatnonzero(c[step:] == c[:-step])
        if not len(i):
            break
        np.add.at(both, (d[i], d[i + step]), 1)
    both += both.T
    many = there > DENSE
    c, d = (np.cumsum(start & many) - 1)[many], doc[many]
    for at in range(0, int(c[-1]) + 1 if len(c) else 0, 1024):
        lo, hi = np.searchsorted(c, [at, at + 1024])
        m = np.zeros((rows, 1024), np.float32)
        m[d[lo:hi], c[lo:hi] - at] = 1
        both += (m @ m.T).astype(np.int32)
    return n, both


def _verify(rows: DataFrame) -> DataFrame:
    """(a, b, links): of each row of (comp, rep, copies, text, lo, hi, own) its cell's forest and its links there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_key(batches, ["comp", "lo", "hi"]):
            for _, cell in pdf.groupby(["comp", "lo", "hi"], sort=False):
                rep, copies = cell["rep"].to_numpy(), cell["copies"].to_numpy()
                n, both = _overlaps(*shingles([normal(t) for t in cell["text"]]))
                near = both * THRESHOLD[1] >= THRESHOLD[0] * (n[:, None] + n[None, :] - both)
                np.fill_diagonal(near, False)
                block = cell["own"].to_numpy()
                if cell["lo"].iloc[0] != cell["hi"].iloc[0]:
                    near &= block[:, None] != block[None, :]
                links = (near * copies[None, :]).sum(1)
                on = links > 0
                if on.any():
                    yield pd.DataFrame({"a": rep[on], "b": _forest(rep, near)[on], "links": links[on]})

    return rows.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi").mapInPandas(run, "a long, b long, links long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """(id_col, class_id, n_links, copies) of every document.

    class_id is the smallest id among all that links connect; n_links counts the other documents at
    a similarity of at least 0.8, copies among them; copies counts the rows with the same words.
    """
    marks = stored(signatures(docs, id_col, text_col, recall), "signatures")
    one = ["sketch", "roots", "size"]
    reps = stored(marks.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in one)), "classes")
    found = candidates(reps)
    comps = components(found)
    drop_stored(found)
    sized = comps.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(reps.select("rep", "copies", "size"), "rep")
    blocks = F.greatest(F.ceil(F.sum("size") / BUDGET), F.ceil(F.count("*") / ROWS))
    members = stored(sized.join(sized.groupBy("comp").agg(blocks.alias("blocks")), "comp").drop("size"), "members")
    drop_stored(comps)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    texts = thin_out(texts, "rep", members, "rep").dropDuplicates(["rep"]).join(members, "rep")
    links = stored(_verify(_cells(texts)), "links")
    drop_stored(members)
    classes = components(links).select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = reps.drop(*one).join(classes, "rep", "left").join(counts, "rep", "left")
    known = known.select("c1", "c2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    return marks.drop(*one).join(known, ["c1", "c2"]).select(F.col("id").alias(id_col), "class_id", "n_links", "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but those that a link or a copy connects to a smaller id; rows with a null id stay.

    docs may have columns of any names.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = stored(found.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("gone")).distinct(), "gone")
    may, stays = split_off(held(docs, key=F.col(id_col).cast("long")), "key", gone, "gone")
    left = may.join(gone, F.col("key") == F.col("gone"), "left_anti")
    return freed(stays.select("row").unionAll(left.select("row")), docs.columns)
