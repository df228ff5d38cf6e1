"""Substring dedup by fixed-block anchors.

A repeat of 13 words covers, wherever it starts, one whole block of the 7-word grid of the document that has it first. So
each document's non-overlapping 7-word blocks are the index, and every rolling 7-word window of every document probes it. A
hit that two documents share is an anchor; from there it is extended window by window, to both sides, as long as 13-word windows
repeat, and the union of those that do is the maximal repeat (maximal_repeats gives these as spans). A window's first holder is
the least doc_id among all that have it; holders meet by the window's identity, so thousands of copies cost an entry a chunk,
never a pair. The identity is two independent hashes of the window's words, 96 bits together: among 10^13 windows fewer than one
pair in a thousand such corpora meets by chance. Words are known by 64-bit hashes, so two windows would also meet if they differ only
in words that collide.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C
from kartoteka.llm import chunks as K

#: Words of a window; a block has (WINDOW + 1) // 2, the longest that fits whole into any window on the grid.
WINDOW = 13
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ASK = "bucket int, chunk long, keys binary, more binary"
ASK_WINDOWS = f"{ASK}, checks binary"
ANCHORS = "chunk long, bucket int, kind int, found binary"


class _Grid:
    """A chunk's words, and the rolling blocks that lie within one document."""

    def __init__(self, chunk: K.Chunk, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.words, self.counts = C.byte_word_hashes(chunk.texts, lower=False)
        self.starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.ids, self.no_id = chunk.ids, chunk.no_id

    def within(self, size: int) -> np.ndarray:
        """Positions at which so many words of one document start."""
        at = np.arange(max(0, len(self.words) - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every rolling block."""
        at = self.within(self.block)
        return at, C.rolling(self.words, self.block, 7)[at]

    def windows_around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a block at one of the positions, by whole documents."""
        near = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(near, np.maximum(anchors - (self.window - self.block), 0), 1)
        np.add.at(near, anchors + 1, -1)
        there = np.cumsum(near)[:-1] > 0
        at = self.within(self.window)
        return at[there[at]]

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 bits by which windows meet, and 32 others that tell those apart which meet by chance."""
        return C.rolling_at(self.words, at, self.window, 13), (C.rolling_at(self.words, at, self.window, 29) >> np.uint64(32)).astype(np.uint32)


def _distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, checks) of the distinct pairs, by keys ascending, and each pair's place among them."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], c[new], place


def _ask_blocks(grid: _Grid, chunk: int, buckets: int) -> pd.DataFrame:
    """The chunk's distinct rolling blocks: which of them lie on the grid, and which two of its documents have."""
    at, h = grid.blocks()
    keys, place = np.unique(h, return_inverse=True)
    on_grid = np.zeros(len(keys), bool)
    on_grid[place[(at - grid.starts[grid.doc[at]]) % grid.block == 0]] = True
    first, last = np.full(len(keys), 1 << 62), np.full(len(keys), -1)
    np.minimum.at(first, place, grid.doc[at])
    np.maximum.at(last, place, grid.doc[at])
    two = last > first
    return pd.DataFrame([(b, chunk, C.packed(keys[s], True), np.packbits(np.r_[on_grid[s], two[s]]).tobytes()) for b, s in K.sent(keys, buckets)], columns=["bucket", "chunk", "keys", "more"])


def _anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, the places among its keys of blocks that are on a grid somewhere and that two documents have."""
    keys = [C.unpacked(k, np.uint64, True) for k in rows["keys"]]
    distinct, place = K.merged(keys)
    sizes = [len(k) for k in keys]
    bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=2 * n).astype(bool) for m, n in zip(rows["more"], sizes, strict=True)]
    on_grid = np.zeros(len(distinct), bool)
    on_grid[place[np.concatenate([x[:n] for x, n in zip(bits, sizes, strict=True)])]] = True
    docs = np.bincount(place, 1 + np.concatenate([x[n:] for x, n in zip(bits, sizes, strict=True)]), len(distinct))
    anchor = (on_grid & (docs >= 2))[place]
    ends = np.cumsum(sizes)
    found = [C.packed(np.flatnonzero(anchor[e - n : e]).astype(np.uint32), True) for e, n in zip(ends, sizes, strict=True)]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"].astype("int32"), "kind": np.int32(0), "found": found})


def _anchored(grid: _Grid, answers: pd.DataFrame, buckets: int) -> np.ndarray:
    """Positions of the chunk's anchors."""
    at, h = grid.blocks()
    keys, place = np.unique(h, return_inverse=True)
    found = dict(zip(answers["bucket"], answers["found"], strict=True))
    anchor = np.zeros(len(keys), bool)
    for b, s in K.sent(keys, buckets):
        anchor[s.start + C.unpacked(found[b], np.uint32, True)] = True
    return at[anchor[place]]


def _extended(grid: _Grid, answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, ...]:
    """(starts of windows around anchors, their distinct keys and checks, each start's place among these)."""
    at = grid.windows_around(_anchored(grid, answers[answers["kind"] == 0], buckets))
    return at, *_distinct(*grid.window_hashes(at))


#: Stands for the id null: no id is less than a null one, nor a null one than any.
_LAST = (1 << 63) - 1


def _ask_windows(grid: _Grid, chunk: int, answers: pd.DataFrame, buckets: int) -> pd.DataFrame:
    at, keys, checks, place = _extended(grid, answers, buckets)
    ids = np.where(grid.no_id, _LAST, grid.ids)[grid.doc[at]]
    least = np.full(len(keys), _LAST, np.int64)
    np.minimum.at(least, place, ids)
    rows = [(b, chunk, C.packed(keys[s], True), C.packed(least[s]), C.packed(checks[s])) for b, s in K.sent(keys, buckets)]
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "more", "checks"])


def _first_holders(rows: pd.DataFrame) -> pd.DataFrame:
    keys = [C.unpacked(k, np.uint64, True) for k in rows["keys"]]
    distinct, _, place = _distinct(np.concatenate(keys), np.concatenate([C.unpacked(c, np.uint32) for c in rows["checks"]]))
    least = np.full(len(distinct), _LAST, np.int64)
    np.minimum.at(least, place, np.concatenate([C.unpacked(m, np.int64) for m in rows["more"]]))
    ends = np.cumsum([len(k) for k in keys])
    found = [C.packed(least[place[e - len(k) : e]]) for e, k in zip(ends, keys, strict=True)]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"].astype("int32"), "kind": np.int32(1), "found": found})


def _removed(grid: _Grid, answers: pd.DataFrame, buckets: int) -> np.ndarray:
    """For each word of the chunk, whether it lies in a window that a smaller doc_id has."""
    at, keys, _, place = _extended(grid, answers, buckets)
    found = answers[answers["kind"] == 1]
    found = dict(zip(found["bucket"], found["found"], strict=True))
    least = np.empty(len(keys), np.int64)
    for b, s in K.sent(keys, buckets):
        least[s] = C.unpacked(found[b], np.int64)
    own = grid.doc[at]
    again = at[(least[place] < grid.ids[own]) & ~grid.no_id[own]]
    cover = np.zeros(len(grid.words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + grid.window, -1)
    return np.cumsum(cover)[:-1] > 0


def _digest(texts: list[bytes], counts: np.ndarray, removed: np.ndarray) -> tuple[list, ...]:
    gone, sha, at = [], [], 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        out = removed[at : at + n]
        at += n
        words = t.split()
        gone.append(int(out.sum()))
        if gone[-1]:
            words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
        sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return gone, sha


def _left(text: bytes, removed: np.ndarray) -> str:
    """The text without its removed words and the white space after each of them."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for (a, _), following, gone in zip(spans, [*(s[0] for s in spans[1:]), len(text)], removed.tolist(), strict=True):
        if gone:
            out.append(text[at:a])
            at = following
    return b"".join([*out, text[at:]]).decode()


def _located(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, int]:
    chunks, buckets = K.chunked(docs)

    def ask(batches):
        for b in batches:
            for row in b.itertuples():
                yield _ask_blocks(_Grid(K.Chunk(row), window), row.chunk, buckets)

    anchors = K.answered(chunks.mapInPandas(ask, ASK), _anchors, ANCHORS, "anchors", buckets)

    def windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_ask_windows(_Grid(K.Chunk(row), window), row.chunk, right, buckets) for row in left.itertuples()])

    asked = chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInPandas(windows, ASK_WINDOWS)
    holders = K.answered(asked, _first_holders, ANCHORS, "holders", buckets)
    return chunks, anchors.unionByName(holders), buckets


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of doc_id and text.

    A word is removed if a window of `window` words that covers it also starts in a document with a smaller doc_id. A null
    text has no words. Rows with one doc_id don't remove each other's words. A row whose doc_id is null keeps all words and
    removes none. An empty table gives an empty one. A long text is read whole, as a chunk of its own. Windows are compared by
    96 bits of hashes of their words.
    """
    chunks, answers, buckets = _located(docs, window)

    def made(chunk: K.Chunk, found: pd.DataFrame) -> pd.DataFrame:
        grid = _Grid(chunk, window)
        gone, sha = _digest(chunk.texts, grid.counts, _removed(grid, found, buckets))
        return pd.DataFrame({"doc_id": chunk.doc_ids(), "n_words": grid.counts, "n_removed": gone, "kept_sha256": sha})

    return K.together(chunks, answers, made, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def maximal_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length of the longest runs of words (from 0) that repeated_words removes, in each row.

    A row without such words, a null or empty text among them, gives none; equal rows give equal runs, one each a row. An empty
    table gives an empty one.
    """
    chunks, answers, buckets = _located(docs, window)

    def made(chunk: K.Chunk, found: pd.DataFrame) -> pd.DataFrame:
        grid = _Grid(chunk, window)
        removed = _removed(grid, found, buckets)
        goes_on = np.zeros(len(removed) + 1, bool)  # whether a word's run began before it
        goes_on[1:-1] = removed[:-1] & removed[1:] & (grid.doc[:-1] == grid.doc[1:])
        first = np.flatnonzero(removed & ~goes_on[:-1])
        last = np.flatnonzero(removed & ~goes_on[1:])
        doc = grid.doc[first]
        return pd.DataFrame({"doc_id": pd.array(grid.ids[doc], dtype="Int64"), "start": first - grid.starts[doc], "length": last - first + 1})

    return K.together(chunks, answers, made, "doc_id long, start long, length long")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs (doc_id, text and any more columns), texts without the words that repeated_words removes.

    Of a text that changes, n_chars (if there) is the new length; a text that loses all words stays as an empty one. Other
    rows and columns stay as they are.
    """
    chunks, answers, buckets = _located(docs, window)

    def made(chunk: K.Chunk, found: pd.DataFrame) -> pd.DataFrame:
        grid = _Grid(chunk, window)
        removed = _removed(grid, found, buckets)
        out = []
        for i, t, a, n in zip(chunk.ids.tolist(), chunk.texts, grid.starts.tolist(), grid.counts.tolist(), strict=True):
            if (gone := removed[a : a + n]).any():
                out.append((i, hashlib.sha256(t).hexdigest(), _left(t, gone)))
        return pd.DataFrame(out, columns=["_id", "_was", "_left"])

    # equal rows change alike, so that the id and the text before name a change
    i, was, left = (C.free_name(x, docs.columns) for x in ("id", "was", "left"))
    changed = K.together(chunks, answers, made, "_id long, _was string, _left string").dropDuplicates(["_id", "_was"]).toDF(i, was, left)
    out = docs.join(changed, (F.col("doc_id") == F.col(i)) & (F.sha2("text", 256) == F.col(was)), "left")
    new = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(left).isNotNull(), F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(docs.columns)
