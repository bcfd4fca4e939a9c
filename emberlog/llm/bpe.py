"""BPE encoding and decoding with batched numpy merge rounds.

The vocabulary file is that of the tokenizers library with the normaliser NFC, white space, lower
case, a letters/number/other split and byte-level symbols with a word end. The symbols of many
words lie in one flat array. Each round finds every word's lowest-rank adjacent pair by binary
search over sorted pair keys and merges it in all words at once, until no word has a pair left.
What stands between white space (a chunk) is known by two 64-bit hashes, found for all chunks of about a
quarter of a million characters at once, and the ids of the most used chunks are remembered in flat arrays.

Texts of any length are encoded whole, in pieces cut at white space. A text null or empty has no ids and
decodes to "". Repeated rows are encoded each for itself, ids may be of any type or null, other columns of whatever
names are not read, and an empty table gives no rows. Letters and digits follow the Unicode tables of the regex
module; those of a version newer than the tokenizers library's are letters here and other characters there. Ties do not arise: of equal pairs the leftmost is merged.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the vocabulary's format: its split pattern and word end.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# White space of the Unicode standard; str.split() also splits at \x1c-\x1f, which are not.
SPACE = "\t-\r \x85\xa0  -     　"
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """An encoder and decoder over one vocabulary file. keep: most chunks of text whose ids are remembered."""

    def __init__(self, path: str, keep: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = byte_symbols()
        self.inner = np.array([vocab[c] for c in marks], np.int32)
        self.final = np.array([vocab[c + WORD_END] for c in marks], np.int32)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(names) + 1
        self.names = [names.get(i, "").encode() for i in range(self.size)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        # A merge whose product can merge on at a lower rank must be done one at a time.
        first = np.full(self.size, NONE, np.int64)
        np.minimum.at(first, left, np.arange(len(left)))
        np.minimum.at(first, right, np.arange(len(left)))
        self.single = first[made] < np.arange(len(left))
        self.word = regex.compile(WORD + "| ")
        self.space = regex.compile(f"[{SPACE}]+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # Whether a code point is white space; the last entry stands for all beyond.
        self.is_space = np.array([self.space.match(chr(c)) is not None for c in range(0x3001)] + [False])
        self.keep = keep
        self.memory = Memory()

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words, one after the other, and the number of ids of each."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), NONE, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.pair_ranks(sym[inside], sym[inside + 1])
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lows = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            low = np.repeat(lows, sizes)
            over = low == NONE
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                go = ~over
                sym, word, rank, low = sym[go], word[go], rank[go], low[go]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            # Of overlapping pairs (equal symbols in a row) every other one is merged, from the left.
            new_run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])]
            head = np.maximum.accumulate(np.where(new_run, hit, 0))
            hit = hit[(hit - head) % 2 == 0]
            one = self.single[low[hit]]
            if one.any():
                first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
                hit = hit[first | ~one]
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            moved = hit - np.arange(len(hit))
            sym, word, rank = sym[stay], word[stay], rank[stay]
            touched = np.concatenate([moved, moved[moved > 0] - 1])
            rank[touched] = NONE
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self.pair_ranks(sym[touched], sym[touched + 1])
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks (no white space in them), one after the other, and the number of ids of each."""
        parts = None  # of each chunk: plain strings and special tokens in turn, where there is a special token
        plain = chunks
        if self.split_special and any("<|" in c for c in chunks):
            parts = [self.split_special.split(c) for c in chunks]
            plain = [p for c in parts for p in c[::2]]
        tokens = self.word.findall(unicodedata.normalize("NFC", " ".join(plain)).replace("Σ", "σ").lower())
        number = dict.fromkeys(tokens)
        number.pop(" ", None)
        number = {t: i for i, t in enumerate(number)}
        ids, count = self.encode_words([t.encode() for t in number])
        number[" "] = -1
        words = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        ends = np.flatnonzero(words < 0)
        ends = np.r_[ends - np.arange(len(ends)), len(tokens) - len(ends)]  # words up to the end of each plain string
        words = words[words >= 0]
        first = np.cumsum(count) - count
        ids, lengths = gather(ids, first[words], count[words]), count[words]
        plain_end = np.r_[0, np.r_[0, np.cumsum(lengths)][ends]]
        if parts is None:
            return ids, np.diff(plain_end)
        pieces, sizes, k = [], [], 0
        for c in parts:
            own = []
            for n, p in enumerate(c):
                if n % 2:
                    own.append(np.array([self.special[p]], np.int32))
                else:
                    own.append(ids[plain_end[k] : plain_end[k + 1]])
                    k += 1
            pieces += own
            sizes.append(sum(map(len, own)))
        return np.concatenate(pieces), np.array(sizes)

    def _pieces(self, text: str) -> Iterator[str]:
        """text in pieces of about ROOM characters, cut at white space."""
        at = 0
        while len(text) - at > ROOM and (m := self.space.search(text, at + ROOM)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order."""
        group: list[str] = []
        room = 0
        for text in texts:
            text = text or ""
            if room + len(text) > ROOM and group:
                yield from self._encode(group)
                group, room = [], 0
            if len(text) > 2 * ROOM:
                yield np.concatenate([self._encode([p])[0] for p in self._pieces(text)])
                continue
            group.append(text)
            room += len(text)
        if group:
            yield from self._encode(group)

    def _encode(self, group: list[str]) -> list[np.ndarray]:
        joined = "\n".join(group) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        space = self.is_space[np.minimum(code, len(self.is_space) - 1)]
        start = np.flatnonzero(~space & np.r_[True, space[:-1]])
        end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
        bounds = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
        size = np.bincount(np.searchsorted(bounds, start, side="right"), minlength=len(group))
        # Each chunk's entry among `names`: short ones by their hashes, long ones each for itself.
        brief = end - start <= BRIEF
        key, other = hashes_of(code, start[brief], end[brief])
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if (other[first][inverse] != other).any():  # two chunks of one key: tell them apart by both hashes
            unique, first, inverse = np.unique(np.stack([key, other], 1), axis=0, return_index=True, return_inverse=True)
            unique, inverse = unique[:, 0], inverse.reshape(-1)
        other = other[first]
        known = self.memory.find(unique, other)
        missed = np.flatnonzero(known < 0)
        long = np.flatnonzero(~brief)
        where = np.r_[np.flatnonzero(brief)[first[missed]], long]
        ids, count = self._learn([joined[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]) if len(where) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        at = self.memory.room_for(ids) + np.cumsum(count) - count
        entry_at, entry_count = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        hit = known >= 0
        entry_at[hit], entry_count[hit] = self.memory.at[known[hit]], self.memory.count[known[hit]]
        entry_at[missed], entry_count[missed] = at[: len(missed)], count[: len(missed)]
        chunk_at, chunk_count = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        chunk_at[brief], chunk_count[brief] = entry_at[inverse], entry_count[inverse]
        chunk_at[long], chunk_count[long] = at[len(missed) :], count[len(missed) :]
        out = gather(self.memory.flat, chunk_at, chunk_count).astype(np.uint32)
        ends = np.r_[0, np.cumsum(chunk_count)][np.cumsum(size)]
        uses = np.bincount(inverse, minlength=len(unique))
        self.memory.used[known[hit]] += uses[hit].astype(np.int32)
        self.memory.add(unique[missed], other[missed], at[: len(missed)], count[: len(missed)], uses[missed], self.keep)
        return np.split(out, ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: this vocabulary file has no decoder, so tokens are joined by a space."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


ROOM = 1 << 18
#: Longest chunk that is known by its hashes. Polynomials modulo 2^64 have systematic clashes from about 1,000 characters on.
BRIEF = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []
_VALUES: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashes_of(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run code[start:end] of code points."""
    if not _VALUES:
        points = np.arange(1 << 16, dtype=np.uint64)
        _VALUES.extend(_mix(points + np.uint64(salt)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    if not _POWERS or len(_POWERS[0]) < len(code) + 1:
        size = max(ROOM * 2, len(code) + 1)
        _POWERS[:] = []
        for base in (_BASE, _UNBASE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    up, down = _POWERS
    out = []
    sums = np.zeros(len(code) + 1, np.uint64)
    plain = code.max(initial=0) < 1 << 16
    for values in _VALUES:
        worth = values[code] if plain else values[code & 0xFFFF] + _mix(values[code >> 16])
        worth *= up[: len(code)]
        np.cumsum(worth, out=sums[1:])
        out.append(_mix((sums[end] - sums[start]) * down[start]))
    return out[0], out[1]


class Memory:
    """The ids of chunks known by two hashes: arrays sorted by the first, ids in one flat array of which `filled` are taken."""

    def __init__(self) -> None:
        self.key, self.other = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.count, self.used = (np.zeros(0, np.int32) for _ in range(3))
        self.flat, self.filled = np.zeros(1 << 16, np.int32), 0

    def find(self, key: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The entry of each chunk, or -1."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[i] == key) & (self.other[i] == other), i, -1)

    def room_for(self, ids: np.ndarray) -> int:
        """Puts ids behind those taken, to stay only as far as add() takes them; returns their place."""
        if self.filled + len(ids) > len(self.flat):
            more = np.zeros(max(len(self.flat) * 3 // 2, self.filled + len(ids)), np.int32)
            more[: self.filled] = self.flat[: self.filled]
            self.flat = more
        self.flat[self.filled : self.filled + len(ids)] = ids
        return self.filled

    def add(self, key: np.ndarray, other: np.ndarray, at: np.ndarray, count: np.ndarray, used: np.ndarray, keep: int) -> None:
        """Takes chunks, in the order of their keys; beyond `keep` entries the more used half stays."""
        if not len(key):
            return
        self.filled = int(at[-1] + count[-1])
        new = np.searchsorted(self.key, key) + np.arange(len(key))
        old = np.ones(len(self.key) + len(key), bool)
        old[new] = False
        for name, more in (("key", key), ("other", other), ("at", at), ("count", count), ("used", used)):
            was = getattr(self, name)
            out = np.empty(len(old), was.dtype)
            out[new], out[old] = more, was
            setattr(self, name, out)
        if len(self.key) > keep:
            # Uses halve, so that what was frequent long ago goes in the end.
            stay = np.sort(np.argpartition(self.used, -(keep // 2))[-(keep // 2) :])
            for name in ("key", "other", "at", "count", "used"):
                setattr(self, name, getattr(self, name)[stay])
            self.flat = gather(self.flat, self.at, self.count)
            self.filled = len(self.flat)
            self.at = (np.cumsum(self.count) - self.count).astype(np.int32)
            self.used >>= 1


def gather(flat: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[at:at+count], one after the other."""
    total = int(count.sum())
    if not total:
        return flat[:0]
    begin = np.cumsum(count) - count
    return flat[np.repeat(at - begin, count) + np.arange(total)]


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded): every text's ids and the text they decode to. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary)
        for pdf in batches:
            ids = list(bpe.encode_batch(pdf["text"].tolist()))
            yield pd.DataFrame({"id": pdf["id"], "ids": [i.astype(np.int32) for i in ids], "decoded": [bpe.decode(i).decode() for i in ids]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, ids array<int>, decoded string")
    return rows.withColumn("id", F.col("id").cast(kind))


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the same encoding, without moving ids to the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary)
        for pdf in batches:
            rows = []
            for ids in bpe.encode_batch(pdf["text"].tolist()):
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.withColumn("id", F.col("id").cast(kind))
