"""Tokens of two tokenizers over the same bytes, aligned by byte-owner arrays.

Each byte of a text is owned by one token of A and one of B: np.repeat of token numbers by token lengths. Runs of one owner pair
are the overlaps; where both owners change at once both tokens end, and the text is cut into groups there.

Texts are cut before each single space or line feed between other characters. No match of A's pre-tokeniser and no piece of B
crosses such a place, so both end there: tokens and groups of the segments, joined, are those of the text. A chunk of documents
encodes and aligns each distinct segment once; texts with other white space are one segment.

How many documents hold a pair of ids linked is counted corpus-wide: chunks count their own distinct pairs, which are summed by
pair, and each chunk asks for its distinct pairs alone. So a word that stands everywhere costs an entry a chunk.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C
from kartoteka.llm import packing, pieces

#: UTF-8 bytes of a chunk's texts; a longer document is a chunk of its own.
CHUNK_BYTES = 4_000_000
#: Ids of B are below this; a pair is id of A * PAIR + id of B.
PAIR = 1 << 20
#: Linked pairs that are written out at once.
PAIRS_AT_ONCE = 1 << 21
#: Characters of segments that are encoded as one text.
JOINED = 50_000
#: White space that isn't a single space or line feed between other characters, in a text with a space in front.
ODD_SPACE = re.compile(r"\s\s|\s\Z|\0")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
CHUNK_SCHEMA = "chunk long, ids binary, no_id binary, sums binary, hashes binary, sizes binary, codes binary, times binary, pairs array<long>, held array<long>"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes of Latin-1 as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers; ids are arrays. Memory of segments is bounded."""

    def __init__(self, a: str, ranks: str | None, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.b = pieces.pieces(b)
        byte_of, size = _byte_of(), self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        # an entry that is not byte-level, such as a special token, never comes out
        self.a_bytes = [bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else b"" for t in entries]
        model = self.b.model
        said = [model.id_to_piece(i) for i in range(self.b.size)]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace(pieces.MARK, " ").encode() for i, t in enumerate(said)]
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # ids in decimal with what may follow: of A, then of B from b_said on
        self.b_said = 2 * size
        self.said = np.array([f"{i}{end}".encode() for n, ends in ((size, ",|"), (self.b.size, ",;")) for end in ends for i in range(n)], object)
        self.said_len = np.fromiter(map(len, self.said), np.int64, len(self.said))
        self.latin = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.latin = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _a(self, text: str) -> list[int]:
        if self.latin and (text.isascii() or max(text) < packing.LATIN):
            return self.latin(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _a_segments(self, segments: list[str]) -> list[bytes]:
        """Segments of like script are encoded as one text, whose ids are told apart by their bytes."""
        out: list = [b""] * len(segments)
        latin = [s.isascii() or max(s) < packing.LATIN for s in segments]
        for kind in (True, False):
            those = [i for i, x in enumerate(latin) if x is kind]
            at = 0
            while at < len(those):
                part, size = [], 0
                while at < len(those) and size < JOINED:
                    part.append(those[at])
                    size += len(segments[those[at]])
                    at += 1
                ids = np.array(self._a("".join(segments[i] for i in part)), "<u4")
                ends = np.cumsum(self.a_len[ids])
                wanted = np.cumsum([len(segments[i].encode()) for i in part])
                places = np.searchsorted(ends, wanted) + 1
                for i, a, b in zip(part, [0, *places[:-1].tolist()], places.tolist(), strict=True):
                    out[i] = ids[a:b].tobytes()
        return out

    def segments(self, segments: list[str], whole: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids by A and by B of each segment, then of each whole text with a space in front."""
        C.claim(self)
        out = [self.young.get(s) or self.old.get(s) for s in segments]
        absent = [i for i, v in enumerate(out) if v is None]
        new = [segments[i] for i in absent]
        for i, *ids in zip(absent, self._a_segments(new), self.b.chunks(new), strict=True):
            out[i] = tuple(ids)
        # what was not met for a generation is forgotten; long segments are not kept at all
        self.young.update((s, v) for s, v in zip(segments, out, strict=True) if len(s) <= C.MEMO_BYTES)
        if len(self.young) > C.MEMO:
            self.young, self.old = {}, self.young
        by_a, by_b = [list(x) for x in zip(*out, strict=True)] if out else ([], [])
        by_a += [np.array(self.a.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in whole]
        by_b += [np.array(self.b.model.encode(t[1:], num_threads=1), "<u4").tobytes() for t in whole]
        return by_a, by_b


@functools.cache
def pair(a: str, ranks: str | None, b: str) -> Pair:
    return Pair(a, ranks, b)


def _settings(a: str | None, b: str | None) -> tuple[str, str | None, str]:
    return a or packing.default_tokenizer(), None if a else packing.default_ranks(), b or pieces.default_model()


def owners(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens over the same bytes, by their lengths: the group of each token of A, that of each of B, and overlaps as rows
    (token of A, token of B), all in order."""
    own_a, own_b = np.repeat(np.arange(len(a_len)), a_len), np.repeat(np.arange(len(b_len)), b_len)
    new_a, new_b = np.diff(own_a, prepend=-1) != 0, np.diff(own_b, prepend=-1) != 0
    group = np.cumsum(new_a & new_b) - 1
    starts = np.flatnonzero(new_a | new_b)
    return group[new_a], group[new_b], np.stack([own_a[starts], own_b[starts]], 1)


def split(texts: list[str]) -> tuple[list[str], list[str], list[np.ndarray]]:
    """Distinct segments of texts with a space in front, whole texts that can't be cut, and for each text the places of its parts
    among both."""
    cut = [t.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:] if t and "\0" not in t else [] for t in (" " + t if t else t for t in texts)]
    distinct = list(dict.fromkeys(chain.from_iterable(cut)))
    odd = {s for s in distinct if ODD_SPACE.search(s)}
    whole = [i for i, (t, s) in enumerate(zip(texts, cut, strict=True)) if t and (not s or odd and not odd.isdisjoint(s))]
    if whole:
        for i in whole:
            cut[i] = []
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
    at = dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__
    places = [np.fromiter(map(at, s), np.int64, len(s)) for s in cut]
    for k, i in enumerate(whole, len(distinct)):
        places[i] = np.array([k])
    return distinct, [" " + texts[i] for i in whole], places


def _linked(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, segment: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segments, pairs, times) of the links of groups, each segment and pair once in a part; a part has a bounded number of
    links, unless one token of A has more."""
    a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    group = np.repeat(np.arange(len(n_a)), n_a)  # of each token of A
    width = n_b[group]
    part = np.cumsum(width) // PAIRS_AT_ONCE
    for of in np.split(np.arange(len(a)), np.flatnonzero(np.diff(part)) + 1):
        if not len(of):
            continue
        w = width[of]
        left = np.repeat(of, w)
        inside = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
        right = b_at[group[left]] + inside
        rows = np.stack([segment[group[left]], a[left].astype(np.int64) * PAIR + b[right]], 1)
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        first = np.flatnonzero(np.any(np.diff(rows, axis=0, prepend=-1) != 0, 1))
        yield rows[first, 0], rows[first, 1], np.diff(first, append=len(rows))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - sizes]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _good(texts: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, p: Pair) -> np.ndarray:
    """Which segments both tokenizers' bytes give back; all at once where all do."""
    given = [t.encode() for t in texts]
    x, y = ([said[i] for i in ids.tolist()] for said, ids in ((p.a_bytes, a), (p.b_bytes, b)))
    size = np.fromiter(map(len, given), np.int64, len(given))
    whole = b"".join(given)
    if (_sums(p.a_len[a], n_a) == size).all() and (_sums(p.b_len[b], n_b) == size).all() and b"".join(x) == whole == b"".join(y):
        return np.ones(len(texts), bool)
    i, j = ([0, *np.cumsum(n).tolist()] for n in (n_a, n_b))
    return np.array([b"".join(x[i[k] : i[k + 1]]) == t == b"".join(y[j[k] : j[k + 1]]) for k, t in enumerate(given)], bool)


def _said(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, segment: np.ndarray, n: int, p: Pair) -> list[bytes]:
    """Each segment's groups in decimal: ids by commas, A from B by a bar, a semicolon after each group."""
    a_end, b_end = np.cumsum(n_a), np.cumsum(n_b)
    code = np.empty(len(a) + len(b), np.int64)
    # each group has its tokens of A, then those of B
    at_a, at_b = np.arange(len(a)) + (b_end - n_b)[group_a], np.arange(len(b)) + a_end[group_b]
    last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
    code[at_a] = a + last_a * len(p.a_len)
    code[at_b] = p.b_said + b + last_b * len(p.b_len)
    whole = b"".join(p.said[code].tolist())
    size = np.bincount(np.concatenate([segment[group_a], segment[group_b]]), weights=np.concatenate([p.said_len[code[at_a]], p.said_len[code[at_b]]]), minlength=n).astype(np.int64)
    ends = np.cumsum(size).tolist()
    return [whole[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _chunk(ids: list, texts: list[str], p: Pair) -> pd.DataFrame:
    # any name will do, as the table is written once
    name = int.from_bytes(np.random.default_rng().bytes(8), "little", signed=True)
    n_docs = len(texts)
    segments, whole, places = split(texts)
    by_a, by_b = p.segments(segments, whole)
    segments += whole
    n = len(segments)
    seg_a, seg_b = (np.fromiter(map(len, x), np.int64, n) // 4 for x in (by_a, by_b))
    a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (by_a, by_b))
    good = _good(segments, a, b, seg_a, seg_b, p)
    if not good.all():  # these have no tokens, and their documents neither
        a, b = a[np.repeat(good, seg_a)], b[np.repeat(good, seg_b)]
        seg_a, seg_b = seg_a * good, seg_b * good
        places = [x if good[x].all() else x[:0] for x in places]
    group_a, group_b, _ = owners(p.a_len[a], p.b_len[b])
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    # both tokens end where a segment does, so a group is of one segment
    segment = np.repeat(np.arange(n), seg_a)[np.cumsum(n_a) - n_a] if n_groups else np.empty(0, np.int64)
    groups = np.bincount(segment, minlength=n)
    links = np.bincount(segment, weights=n_a * n_b, minlength=n).astype(np.int64)
    said = _said(a, b, group_a, group_b, n_a, n_b, segment, n, p)
    hashes = b"".join(hashlib.sha256(b"".join([said[i] for i in x.tolist()])[:-1]).digest() if len(x) else b"\0" * 32 for x in places)
    # documents as runs of segments
    sizes, flat = np.fromiter(map(len, places), np.int64, n_docs), np.concatenate([np.empty(0, np.int64), *places])
    sums = np.stack([_sums(x[flat], sizes) for x in (seg_a, seg_b, groups, links)]) if n_docs else np.zeros((4, 0), np.int64)
    # pairs of distinct segments, then of documents
    parts = list(_linked(a, b, n_a, n_b, segment))
    of, pairs, times = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in parts)]) for k in range(3))
    pairs, code = np.unique(pairs, return_inverse=True)
    run = np.bincount(of, minlength=n)
    order = np.argsort(of, kind="stable")  # a segment's pairs may come in several parts
    code, times = code[order], times[order]
    n, m = max(1, n), max(1, len(pairs))
    key, often = _summed(np.repeat(np.arange(n_docs), sizes) * n + flat, np.ones(len(flat), np.int64))
    doc, seg = np.divmod(key, n)
    at = _spread((np.cumsum(run) - run)[seg], run[seg])
    key, often = _summed(np.repeat(doc, run[seg]) * m + code[at], np.repeat(often, run[seg]) * times[at])
    doc, code = np.divmod(key, m)
    holding = np.bincount(code, minlength=len(pairs))
    used = np.flatnonzero(holding)  # a pair of texts that have no tokens is not held
    code = np.searchsorted(used, code)
    known = np.array([i if i is not None else 0 for i in ids], np.int64)
    row = (name, known.tobytes(), np.array([i is None for i in ids], bool).tobytes(), sums.tobytes(), hashes, np.bincount(doc, minlength=n_docs).astype(np.int64).tobytes())
    row += (C.packed(code.astype(np.uint32)), C.packed(often.astype(np.int64)), pairs[used], holding[used])
    return pd.DataFrame([row], columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])


def _chunks(batches, setting) -> Iterator[pd.DataFrame]:
    p, ids, texts, size = pair(*setting), [], [], 0
    for b in batches:
        for i, null, t in zip(b["doc_id"].tolist(), b["no_id"].tolist(), b["text"], strict=True):
            ids.append(None if null else i)
            texts.append(t or "")
            size += len(texts[-1].encode()) + 64
            if size >= CHUNK_BYTES:
                yield _chunk(ids, texts, p)
                ids, texts, size = [], [], 0
    if ids:
        yield _chunk(ids, texts, p)


def _documents(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Rows of a chunk's documents, given the counts of its pairs."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    if left.empty:
        return pd.DataFrame(columns=columns)
    row = left.iloc[0]
    right = right.sort_values("pair")
    sizes, code, times = np.frombuffer(row["sizes"], np.int64), C.unpacked(row["codes"], np.uint32), C.unpacked(row["times"], np.int64)
    count, best = right["n"].to_numpy(np.int64), right["best"].to_numpy(bool)
    n_best, count_sum = (_sums(x[code] * times if len(code) else times, sizes) for x in (best.astype(np.int64), count))
    sums = np.frombuffer(row["sums"], np.int64).reshape(4, len(sizes))
    ids = pd.Series(pd.array(np.frombuffer(row["ids"], np.int64), dtype="Int64")).mask(np.frombuffer(row["no_id"], bool))
    hashes = [row["hashes"][32 * i : 32 * i + 32].hex() if n else "" for i, n in enumerate(sums[0].tolist())]
    return pd.DataFrame(dict(zip(columns, (ids, *sums, n_best, count_sum, hashes), strict=True)))


def pair_counts(df: DataFrame, a: str | None = None, b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, text) in chunks, and each linked pair (id_a, id_b) with the number n of documents that hold it and
    whether it is best: no other pair of its id of A is held by more."""
    C.small_batches(df.sparkSession)
    setting = _settings(a, b)
    rows = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    chunks = C.written(rows.mapInPandas(lambda batches: _chunks(batches, setting), CHUNK_SCHEMA), "aligned")
    each = chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = C.written(each.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("id_a", F.expr(f"pair div {PAIR}")), "pairs")
    # a row for each id of A: no more than its vocabulary has
    top = F.broadcast(counts.groupBy("id_a").agg(F.max("n").alias("top")))
    return chunks, counts.join(top, "id_a").select("pair", "id_a", (F.col("pair") % PAIR).alias("id_b"), "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_of_documents(df: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """For each document its tokens by A and B, groups, links, links that are best, sum of counts, and the hash of its groups.

    A null or empty text, or one that the tokens' bytes do not give back, has zeros and an empty hash. Repeated rows are documents
    of their own and stay, a null id stays; an empty table gives an empty one; other columns have no effect. A long text is
    aligned whole: memory is bounded by a chunk's texts or the longest one, and by its distinct pairs.
    """
    chunks, counts = pair_counts(df, a, b)
    asked = chunks.select(F.col("chunk").alias("asking"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts.select("pair", "n", "best"), "pair")
    return chunks.drop("pairs", "held").groupBy("chunk").cogroup(answers.groupBy("asking")).applyInPandas(lambda left, right: _documents(left, right), SCHEMA)


def align(df: DataFrame, text: str = "text", to: str = "alignment", a: str | None = None, b: str | None = None) -> DataFrame:
    """Adds the alignment of a text column: ids of A and B, group numbers of both, and overlaps as token numbers.

    A null text gives null; an empty one, or one that the tokens' bytes do not give back, empty arrays. All rows and columns stay.
    """
    setting = _settings(a, b)

    def one(t: str | None, p: Pair) -> tuple | None:
        if t is None:
            return None
        segments, whole, (places,) = split([t])
        by_a, by_b = p.segments(segments, whole)
        x, y = (np.frombuffer(b"".join([of[i] for i in places.tolist()]), "<u4") for of in (by_a, by_b))
        given = " ".encode() + t.encode() if t else b""
        if any(b"".join(map(k.__getitem__, i.tolist())) != given for k, i in ((p.a_bytes, x), (p.b_bytes, y))):
            x = y = x[:0]
        ga, gb, over = owners(p.a_len[x], p.b_len[y])
        return x.astype(np.int32), y.astype(np.int32), ga.astype(np.int32), gb.astype(np.int32), over[:, 0].astype(np.int32), over[:, 1].astype(np.int32)

    def rows(texts: pd.Series) -> pd.DataFrame:
        p = pair(*setting)
        found = [one(t, p) or (None,) * 6 for t in texts]
        return pd.DataFrame(found, columns=["a_ids", "b_ids", "a_groups", "b_groups", "overlap_a", "overlap_b"], dtype=object)

    C.small_batches(df.sparkSession)
    made = F.pandas_udf(rows, ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_groups", "b_groups", "overlap_a", "overlap_b")))
    # null texts have no alignment at all
    return df.withColumn(to, F.when(F.col(text).isNotNull(), made(F.col(text))))
