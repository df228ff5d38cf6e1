"""Byte-level BPE by ranks: a segment tree over byte positions finds the leftmost pair of least rank.

The tree's leaf i holds rank * size + i of the pair that starts at byte i, its inner nodes the least of their children, so
the root names the next merge. A merge changes three leaves (the merged token, its live left neighbour and the token it
swallowed), each a logarithmic update. Pieces of like length are merged side by side in NumPy arrays, so a long piece
without white space costs n log n and thousands of short ones cost few array operations.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C

#: Not a value that ids can have: those are multiples of four bytes.
UNSAFE = b"-"
NONE = np.iinfo(np.int64).max
#: Cells of one array of the side-by-side trees.
CELLS = 1 << 21
#: Pieces of so many bytes or more are merged one by one.
LONG = 1 << 10


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class SplitMemo:
    """Values of texts that can be encoded word by word, with a memo.

    A text is cut before each single space between two characters that are not white space. No match of the usual
    pre-tokeniser pattern crosses such a place, so the ids of the segments, joined, are the ids of the text. Texts with
    other spaces, or with one of whole_texts in them, are left to `whole`.
    """

    def __init__(self, many, whole, memo: int = C.MEMO, whole_texts: list[str] | None = None):
        self.many, self.whole, self.memo, self.whole_texts = many, whole, memo, whole_texts or []
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Values of words that the young memo lacks; UNSAFE for a segment that does not stand alone."""
        old, out, new = self.old, {}, []
        for w in words:
            if (v := old.get(w)) is not None:
                out[w] = v
            elif w[:1] in ("", " ") and (len(w) < 2 or w[1].isspace()) or w[-1].isspace() or w[0].isspace() and w[0] != " ":
                out[w] = UNSAFE
            else:
                new.append(w)
        out.update(zip(new, self.many(new), strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        C.claim(self)
        split = [[" "] if "\0" in t or any(x in t for x in self.whole_texts) else t.replace(" ", "\0 ").split("\0") for t in texts]
        words = list(chain.from_iterable(split))
        values = list(map(self.young.get, words))
        absent = [i for i, v in enumerate(values) if v is None]
        found = self._learn({words[i] for i in absent})
        for i in absent:
            values[i] = found[words[i]]
        out, at = [], 0
        for t, s in zip(texts, split, strict=True):
            parts = values[at : at + len(s)]
            at += len(s)
            out.append((self.whole(t) if t else b"") if UNSAFE in parts else b"".join(parts))
        # what was not met for a generation is forgotten; long words are not kept at all
        self.young.update((w, v) for w, v in found.items() if len(w) <= C.MEMO_BYTES)
        if len(self.young) > self.memo:
            self.young, self.old = {}, self.young
        return out


class Encoder:
    """Ids by ranks, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.vocabulary = [b""] * self.size
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.pattern = regex.compile(pattern)
        self.texts = SplitMemo(self._segments, lambda t: self._segments([t])[0])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair's rank, else NONE."""
        k = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.merged[at], NONE)

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at most `size` bytes, a power of two, merged side by side."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        col = np.arange(size)
        live = col < lengths[:, None]
        tok = np.zeros((n, size + 1), np.int64)
        tok[:, :size][live] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        # live neighbours; `size` stands for none, and its cells take writes that have no effect
        nxt = np.where(col + 1 < lengths[:, None], col + 1, size)
        nxt = np.concatenate([nxt, np.full((n, 1), size)], 1)
        prv = np.concatenate([np.where(col > 0, col - 1, size) + np.zeros((n, 1), np.int64), np.full((n, 1), size)], 1)
        tree = np.full((n, 2 * size), NONE)
        r, i = np.nonzero(nxt[:, :size] < size)
        rank = self._rank(tok[r, i], tok[r, i + 1])
        hit = rank != NONE
        tree[r[hit], size + i[hit]] = rank[hit] * size + i[hit]
        w = size
        while w > 1:
            w //= 2
            tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])
        alive = live
        rows = np.arange(n)

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + size
            tree[rows, node] = value
            while node[0] > 1:  # all are on the same level
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(rows := rows[tree[rows, 1] != NONE]):
            root = tree[rows, 1]
            at, merged = root % size, root // size
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            before = prv[rows, at]
            tok[rows, at] = merged
            alive[rows, gone] = False
            nxt[rows, at] = after
            prv[rows, after] = at
            put(rows, gone, NONE)
            rank = self._rank(merged, tok[rows, after])
            put(rows, at, np.where((after < size) & (rank != NONE), rank * size + at, NONE))
            if len(has := np.flatnonzero(before < size)):
                r, b = rows[has], before[has]
                rank = self._rank(tok[r, b], merged[has])
                put(r, b, np.where(rank != NONE, rank * size + b, NONE))
        ids = tok[:, :size][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_one(self, piece: bytes, size: int) -> bytes:
        """One piece by the same tree and the same updates, on plain lists."""
        n, s, pairs = len(piece), self.size, self.pairs
        tok = self.bytes[np.frombuffer(piece, np.uint8)]
        k = tok[:-1] * s + tok[1:]
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        leaves = np.full(size, NONE)
        leaves[: n - 1] = np.where(self.keys[at] == k, self.merged[at] * size + np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [NONE, *chain.from_iterable(x.tolist() for x in reversed(levels))]
        tok = tok.tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        none = int(NONE)

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least

        while (root := tree[1]) < none:
            i, rank = root % size, root // size
            gone = nxt[i]
            after, before = nxt[gone], prv[i]
            tok[i], tok[gone] = rank, -1
            nxt[i] = after
            if after < n:
                prv[after] = i
            put(gone, none)
            r = pairs.get(rank * s + tok[after]) if after < n else None
            put(i, none if r is None else r * size + i)
            if before >= 0:
                r = pairs.get(tok[before] * s + rank)
                put(before, none if r is None else r * size + before)
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; one that is in the vocabulary is one token."""
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[k] = rank.to_bytes(4, "little")
            else:
                by_size.setdefault(1 << max(2, (len(p) - 1).bit_length()), []).append(k)
        for size, those in by_size.items():
            if size >= LONG:  # few and long: array operations on one or two rows would cost more than they do
                for k in those:
                    out[k] = self._merge_one(pieces[k], size)
                continue
            step = max(1, CELLS // size)
            for a in range(0, len(those), step):
                part = those[a : a + step]
                for k, ids in zip(part, self._merge([pieces[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def _segments(self, texts: list[str]) -> list[bytes]:
        split = [[m.encode() for m in self.pattern.findall(t)] for t in texts]
        new = list({p for s in split for p in s})
        ids = dict(zip(new, self.pieces(new), strict=True))
        return [b"".join(map(ids.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or default_ranks(), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, text: str = "text", to: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the ids of a text column as an array; null gives null, an empty text no ids. All rows and columns stay."""
    setting = _settings(path, pattern)

    def ids(texts: pd.Series) -> pd.Series:
        e = encoder(*setting)
        done = [x for part in C.slices([t or "" for t in texts]) for x in e.texts(part)]
        return pd.Series([None if t is None else np.frombuffer(x, "<u4").astype(np.int32) for t, x in zip(texts, done, strict=True)], dtype=object)

    return df.withColumn(to, F.pandas_udf(ids, "array<int>")(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", to: str = "bytes", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes of an id column; null gives null. Bytes need not be valid UTF-8 where ids were cut."""
    setting = _settings(path, pattern)

    def back(column: pd.Series) -> pd.Series:
        e = encoder(*setting)
        return pd.Series([None if x is None else e.decode(np.asarray(x, "<u4").tobytes()) for x in column], dtype=object)

    return df.withColumn(to, F.pandas_udf(back, "binary")(F.col(ids)))


def digests(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id with the number of tokens and the SHA-256 of ids and of decoded bytes of its text; a null text is empty.

    Row by row: repeated rows stay, an empty table gives an empty one; a long text or match is encoded whole.
    """
    C.small_batches(df.sparkSession)
    setting = _settings(path, pattern)

    def row(texts: pd.Series) -> pd.DataFrame:
        e = encoder(*setting)
        ids = [x for part in C.slices([t or "" for t in texts]) for x in e.texts(part)]
        return pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(e.decode(x)).hexdigest() for x in ids]})

    made = F.pandas_udf(row, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return df.select("doc_id", made(F.col("text")).alias("m")).select("doc_id", "m.*")
