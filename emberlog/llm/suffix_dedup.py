"""Removal of repeated byte strings with a sparse suffix array, sorted deep-shallow.

A byte goes if a string of WINDOW bytes that covers it starts at another place too, in any
document. Every window is known by its anchor, the K-gram in it with the smallest hash, which equal
windows share; so only suffixes at anchors are sorted, about one in 76. Three passes:

1. Anchor hashes are counted; those seen twice set bits in a bitmap of fixed size.
2. Anchors that pass it leave a few numbers each: a 128-bit digest of their surroundings (the bytes that
   windows over them can reach) and their place. Equal surroundings form a class, and all windows of a
   class of two or more are repeats.
3. Where an anchor hash has several classes, and only there, the surroundings of one member of each are
   cut out of the texts. They meet in a task, where what follows and what precedes the anchors is sorted:
   multikey quicksort over 8-byte characters to a shallow depth, blind tries for what is still
   tied. Two anchors share the window that starts d bytes before them if at least d bytes agree to
   the left and WINDOW - d to the right, which the sorted orders and their common prefixes tell.
4. The spans found are merged by document and taken out of the text.

A document is known by its id and a 64-bit hash of its text. Tables written on the way go, and shuffle files
of finished steps are released, as soon as nothing reads them.

An anchor with more than LIMIT classes (a passage in many unlike documents) is not collected: its
range of d is halved and its classes dealt out anew by the bytes that all windows of a half share,
until groups are small; equal surroundings collapse at each step, so a range of one d leaves nothing.

Null counts as empty. Texts shorter than WINDOW lose nothing. Rows repeated with id and text are documents
like any other: each is a repeat of the other. Ids may be of any type, null or repeated. Other columns of docs,
of whatever names, are not read. An empty table gives an empty result. Bytes are UTF-8; what remains may not be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from emberlog.llm.common import drop_stored, in_bitmap, key_bitmap, released, stored, thin_out

WINDOW = 200
K = 50
REACH = WINDOW - K  # an anchor starts at most so many bytes into its window
LIMIT = 4096
SEGMENT = 1 << 20
ANCHOR_BITS = 1 << 25
SHALLOW = 64

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _UNBASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = np.uint64((1 << 23) - 1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS[:] = []
        for base in (_BASE, _UNBASE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return [p[:n] for p in _POWERS]


def _anchors_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors of the segments of data; windows do not cross segments."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    h = (sums[K:] - sums[:-K]) * down[: n - K + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals
    size, span = REACH + 1, 1
    while span * 2 <= size:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if size > span:
        low = np.minimum(low[: len(low) - (size - span)], low[size - span :])
    inside = np.zeros(len(low) + 1, np.int8)
    fit = sizes >= WINDOW
    inside[starts[fit]] += 1
    inside[starts[fit] + sizes[fit] - WINDOW + 1] -= 1
    low = low[np.cumsum(inside[:-1]) > 0]
    place = (low & _PLACE).astype(np.int64)
    if len(place):
        # Neighbouring windows mostly share their anchor.
        place = np.unique(place[np.r_[True, place[1:] != place[:-1]]])
    return h[place], place


def anchors(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, hashes, places) of the anchors of each text with at least one; texts of any length."""
    group: list[tuple[int, int, bytes]] = []
    room = 0

    def flush() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        sizes = np.array([len(b) for _, _, b in group])
        starts = np.cumsum(sizes) - sizes
        h, place = _anchors_of(np.frombuffer(b"".join(b for _, _, b in group), np.uint8), starts, sizes)
        cut = np.searchsorted(place, starts)
        for k, (i, at, _) in enumerate(group):
            own = slice(cut[k], cut[k + 1] if k + 1 < len(group) else None)
            if len(place[own]):
                yield i, at, h[own], place[own] - starts[k] + at

    def parts() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        nonlocal group, room
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - WINDOW + 1), SEGMENT):
                group.append((i, at, text[at : at + SEGMENT + WINDOW - 1]))
                room += len(group[-1][2])
                if room > SEGMENT:
                    yield from flush()
                    group, room = [], 0
        if group:
            yield from flush()

    last: tuple[int, list, list] | None = None
    for i, _, h, place in parts():
        if last and last[0] == i:
            last[1].append(h)
            last[2].append(place)
            continue
        if last:
            yield _whole(last)
        last = (i, [h], [place])
    if last:
        yield _whole(last)


def _whole(parts: tuple[int, list, list]) -> tuple[int, np.ndarray, np.ndarray]:
    h, place = np.concatenate(parts[1]), np.concatenate(parts[2])
    place, first = np.unique(place, return_index=True)  # segments overlap
    return parts[0], h[first], place


def _count_anchors(docs: DataFrame) -> DataFrame:
    """(h, n): the anchor hashes of each batch and whether they are there once or more often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [h for _, h, _ in anchors([bytes(t) for t in pdf["data"]])]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"h": h.astype(np.int64), "n": np.minimum(n, 2)})

    return docs.select("data").mapInPandas(run, "h long, n long")


def _surroundings(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(h, c1, c2, u, v, at) of the anchors whose bit is set: c1 and c2 are the digest of their surroundings, at is
    place * 2^16 + bytes to the left * 2^8 + bytes to the right."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    bits = len(bitmap) * 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, us, vs = [bytes(t) for t in pdf["data"]], pdf["u"].to_numpy(), pdf["v"].to_numpy()
            held, marks, count = [], [], 0

            def flush() -> pd.DataFrame:
                c = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
                h, u, v, at = (np.concatenate(x) for x in zip(*held, strict=True))
                return pd.DataFrame({"h": h, "c1": c[:, 0], "c2": c[:, 1], "u": u, "v": v, "at": at})

            for i, h, place in anchors(texts):
                at = (h & np.uint64(bits - 1)).astype(np.int64)
                on = (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                if not on.any():
                    continue
                text, p = texts[i], place[on]
                left, right = np.minimum(p, REACH), np.minimum(len(text) - p, WINDOW)
                for lo, hi, n in zip((p - left).tolist(), (p + right).tolist(), left.tolist(), strict=True):
                    marks.append(hashlib.blake2b(text[lo:hi], digest_size=16, salt=n.to_bytes(2, "little")).digest())
                held.append((h[on].astype(np.int64), np.full(len(p), us[i]), np.full(len(p), vs[i]), p << 16 | left << 8 | right))
                count += len(p)
                if count > 100_000:
                    yield flush()
                    held, marks, count = [], [], 0
            if held:
                yield flush()

    return docs.select("u", "v", "data").mapInPandas(run, "h long, c1 long, c2 long, u long, v long, at long")


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The order of strings of equal length, by a blind trie: nodes hold branching places only.

    A string goes down by its bytes at branching places alone, to any leaf; the common prefix with
    that leaf's string then tells where it branches off. Equal strings share a leaf.
    """
    size = len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    root: list = [0]  # a leaf: [rows]; an inner node: (place, {byte: node}) as a list of two
    for k in range(1, len(strings)):
        s = strings[k]
        node = root
        while len(node) == 2 and isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        leaf = node[0]
        same = size - (((numbers[k] ^ numbers[leaf]).bit_length() + 7) >> 3)
        if same == size:
            node.append(k)
            continue
        other = strings[leaf][same]
        node = root
        while len(node) == 2 and isinstance(node[1], dict) and node[0] < same:
            node = node[1][s[node[0]]]
        if len(node) == 2 and isinstance(node[1], dict) and node[0] == same:
            node[1][s[same]] = [k]
        else:
            node[:] = [same, {other: list(node), s[same]: [k]}]
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if len(node) == 2 and isinstance(node[1], dict):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(matrix: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the rows of matrix (rows, bytes) by (group, bytes).

    Multikey quicksort, all segments of a level at once: each is parted at a pivot, its middle row's character
    at its depth (a character is 8 bytes), into less, equal and greater; only the equal part goes one
    character deeper. What is tied at the shallow depth is left to blind tries.
    """
    wide = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), wide), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    words = padded.view(">u8").astype(np.uint64)
    deepest = min(shallow // 8, words.shape[1])
    order = np.argsort(group, kind="stable")
    own = group[order]
    places = np.arange(len(order))  # places in order whose rows are in segments of two or more
    segment = np.cumsum(np.r_[True, own[1:] != own[:-1]]) - 1 if len(own) else places
    depth = np.zeros(len(order), np.int64)
    tied: list[np.ndarray] = []
    while True:
        more = np.bincount(segment)[segment] > 1 if len(segment) else np.zeros(0, bool)
        places, segment, depth = places[more], segment[more], depth[more]
        deep = depth >= deepest
        if deep.any():
            at = places[deep]
            cut = np.flatnonzero(np.diff(segment[deep])) + 1
            tied += np.split(at, cut)
            places, segment, depth = places[~deep], segment[~deep], depth[~deep]
        if not len(places):
            break
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[first, len(segment)])
        rows = order[places]
        character = words[rows, depth]
        pivot = np.repeat(character[first + size // 2], size)
        side = 1 + (character > pivot) - (character < pivot).astype(np.int64)
        part = np.repeat(np.arange(len(first)), size) * 3 + side
        sub = np.argsort(part, kind="stable")
        order[places] = rows[sub]
        part = part[sub]
        depth = depth + (part % 3 == 1)
        segment = np.cumsum(np.r_[True, part[1:] != part[:-1]]) - 1
    for at in tied:
        rows = order[at]
        order[at] = rows[blind_trie_order([padded[r].tobytes() for r in rows])]
    return order


def _classes(matrix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted rows and the bytes each has in common with the one before (-1 across groups)."""
    order = deep_shallow(matrix, group)
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        a, b = matrix[order[1:]], matrix[order[:-1]]
        unlike = a != b
        common[1:] = np.where(unlike.any(1), unlike.argmax(1), matrix.shape[1])
        common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def repeats(group: np.ndarray, ctx: list[bytes], left: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(rows, REACH + 1) boolean: whether the window d bytes before a row's anchor, lo <= d <= hi, is another row's too."""
    n = len(ctx)
    after, before = np.zeros((n, WINDOW), np.uint8), np.zeros((n, REACH), np.uint8)
    for k, c in enumerate(ctx):
        raw = np.frombuffer(c, np.uint8)
        m = left[k]
        after[k, : len(raw) - m] = raw[m:]
        before[k, :m] = raw[:m][::-1]
    r_order, r_common = _classes(after, group)
    l_order, l_common = _classes(before, group)
    out = np.zeros((n, REACH + 1), bool)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        on = np.flatnonzero((lo <= d) & (d <= hi))
        if len(on) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < WINDOW - d)
        l_class[l_order] = np.cumsum(l_common < d)
        key = r_class[on] * (n + 1) + l_class[on]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.r_[same, False] | np.r_[False, same]
        out[on[order[twice]], d] = True
    return out


#: Spans are carried as start * 2^12 + length.
SPAN = 12


def _spans(flags: np.ndarray, u: np.ndarray, v: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    """(u, v, span) of the bytes that each row's repeated windows cover, run by run of d."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return pd.DataFrame({"u": u[row], "v": v[row], "span": (pos[row] - (last - 1)) << SPAN | (last - 1 - first + WINDOW)})


def _sort_groups(rows: DataFrame) -> DataFrame:
    """(u, v, span) from groups (key, u, v, pos, left, lo, hi, alone, ctx) of at most LIMIT rows each; for rows alone in their class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf["key"].to_numpy()
            group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
            flags = repeats(group, [bytes(c) for c in pdf["ctx"]], pdf["left"].to_numpy(), pdf["lo"].to_numpy(), pdf["hi"].to_numpy())
            alone = pdf["alone"].to_numpy()
            return _spans(flags[alone], *(pdf[c].to_numpy()[alone] for c in ("u", "v", "pos")))

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            count += len(pdf)
            if count >= 2 * LIMIT:
                every = pd.concat(held, ignore_index=True)
                cut = int(np.argmax(every["key"].to_numpy() == every["key"].iloc[-1]))
                if cut:
                    yield work(every.iloc[:cut])
                    every = every.iloc[cut:].reset_index(drop=True)
                held, count = [every], len(every)
        if count:
            yield work(pd.concat(held, ignore_index=True))

    own = rows.select("key", "u", "v", "pos", "left", "lo", "hi", "alone", "ctx").repartition("key").sortWithinPartitions("key")
    return own.mapInPandas(run, "u long, v long, span long")


def _span(lo: str, hi: str):
    """The bytes that windows from d = hi to d = lo before an anchor cover together."""
    return ((F.col("pos") - F.col(hi)) * (1 << SPAN) + F.col(hi) - F.col(lo) + WINDOW).alias("span")


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups too large for a task, with their range of d halved: (spans settled, rows left (key, dlo, dhi, …))."""
    mid = F.floor((F.col("dlo") + F.col("dhi")) / 2).cast("int")
    two = rows.withColumn("half", F.explode(F.array(F.struct(F.col("dlo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("dhi").alias("b")))))
    two = two.withColumns({"dlo": F.col("half.a"), "dhi": F.col("half.b")}).where("dlo <= dhi").drop("half")
    two = two.withColumns({"lo": F.greatest("lo", "dlo"), "hi": F.least("hi", "dhi")}).where("lo <= hi")
    core = F.expr(f"substring(ctx, left - dlo + 1, {WINDOW} - dhi + dlo)")
    # What windows of the half can reach, and where a text ends inside that.
    reach = F.expr(f"substring(ctx, left - hi + 1, {WINDOW} - lo + hi)")
    two = stored(two.withColumns({"key": F.xxhash64("key", "dlo", "dhi", core), "mark": F.md5(F.concat(reach, F.encode(F.concat_ws(",", "lo", "hi"), "utf-8")))}), "halves")
    same = two.groupBy("key", "mark").agg(F.count("*").alias("n"), F.min(F.struct("u", "v", "pos")).alias("first"))
    met = two.join(same, ["key", "mark"])
    settled = met.where("n > 1").select("u", "v", _span("lo", "hi"))
    first = met.where(F.struct("u", "v", "pos") == F.col("first"))
    return settled, first.withColumn("alone", F.col("alone") & (F.col("n") == 1)).drop("first", "n", "mark")


def _in_groups(rows: DataFrame) -> DataFrame:
    """rows (key, …) whose key others have too, with the size of their group."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "key")


def find_repeats(docs: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(u, v, span): spans of bytes to remove, overlapping, of documents (u, v, data); see SPAN. Tables that it reads join made."""
    seen = _count_anchors(docs).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    bitmap = key_bitmap(seen, "h", ANCHOR_BITS, hashed=True)
    rows = stored(_surroundings(docs, bitmap), "anchors")
    classes = rows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.min(F.struct("u", "v", "at")).alias("first"))
    left, right = F.shiftright("first.at", 8).bitwiseAND(F.lit(255)).cast("int"), F.col("first.at").bitwiseAND(F.lit(255)).cast("int")
    classes = classes.select("c1", "c2", "n", F.col("h").alias("key"), "first.u", "first.v", F.shiftright("first.at", 16).alias("pos"), left.alias("left"), right.alias("right"))
    classes = classes.withColumns({"lo": F.greatest(F.lit(0), F.lit(WINDOW) - F.col("right")), "hi": F.col("left")}).where("lo <= hi")
    classes = stored(classes, "anchor-classes")
    # A class of more than one is settled as a whole; one member stands for it in its group, where others may meet it.
    many = classes.where("n > 1").select("c1", "c2", "lo", "hi")
    found = [rows.select("c1", "c2", "u", "v", F.shiftright("at", 16).alias("pos")).join(many, ["c1", "c2"]).select("u", "v", _span("lo", "hi"))]
    found = [stored(found[0], "spans")]
    made.append(found[0])
    drop_stored(rows)
    groups = stored(_in_groups(classes.withColumn("alone", F.col("n") == 1).drop("n", "c1", "c2")), "anchor-groups")
    drop_stored(classes)
    released(docs)
    texts = thin_out(docs, "u", groups, "u")
    met = groups.join(texts, ["u", "v"]).withColumn("ctx", F.expr("substring(data, cast(pos - left + 1 as int), left + right)")).drop("data", "right")
    found.append(stored(_sort_groups(met.where(F.col("size") <= LIMIT)), "spans"))
    made.append(found[-1])
    large = met.where(F.col("size") > LIMIT).drop("size").withColumns({"dlo": F.lit(0), "dhi": F.lit(REACH)})
    large = stored(large, "large-groups")
    made += [groups, large]
    while large.limit(1).count():
        more, live = _halves(large)
        found.append(more)
        groups = stored(_in_groups(live), "groups")
        made.append(groups)
        found.append(_sort_groups(groups.where(F.col("size") <= LIMIT)))
        large = groups.where(F.col("size") > LIMIT).drop("size")
    released(docs)
    return reduce(DataFrame.unionAll, found)


def _spans_by_document(own: DataFrame) -> DataFrame:
    """(u, v, spans): the spans of each document (u, v, data) that has any, sorted, in the shared folder."""
    made: list[DataFrame] = []
    found = find_repeats(own, made)
    out = stored(found.groupBy("u", "v").agg(F.sort_array(F.collect_set("span")).alias("spans")), "document-spans")
    for df in made:
        drop_stored(df)
    del found
    released(own)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row of docs; kept is binary."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    whole = isinstance(kind, (ByteType, ShortType, IntegerType, LongType))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    own = own.withColumns({"u": F.coalesce(F.col("id").cast("long"), F.lit(0)) if whole else F.xxhash64("id"), "v": F.xxhash64("data")})
    spans = _spans_by_document(own.select("u", "v", "data"))
    may = in_bitmap(spark, key_bitmap(spans, "v"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, data, spans in zip(pdf["id"], pdf["data"], pdf["spans"], strict=True):
                data = bytes(data)
                kept, at, runs, gone = [], 0, 0, 0
                end = -1
                for span in spans if spans is not None else ():
                    start, stop = int(span) >> SPAN, (int(span) >> SPAN) + (int(span) & ((1 << SPAN) - 1))
                    if start > end:
                        kept.append(data[at:start])
                        runs += 1
                        gone += stop - start
                    elif stop > end:
                        gone += stop - end
                    at = end = max(end, stop)
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((doc, len(data), gone, runs, left, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    with_spans = own.where(may(F.col("v"))).join(spans, ["u", "v"], "left").select(F.col("id").cast("string").alias("id"), "data", "spans")
    touched = with_spans.mapInPandas(cut, "id string, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumn("id", F.col("id").cast(kind))
    zero = F.lit(0).cast("long")
    others = own.where(~may(F.col("v"))).select("id", F.octet_length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("data").alias("kept"), F.sha2("data", 256).alias("kept_sha256"))
    return touched.unionAll(others).withColumnRenamed("id", id_col)
