"""Best-fit packing of token pieces into fixed-length sequences by swap-based local search."""

from __future__ import annotations

import base64
import functools
import os
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C
from kartoteka.llm.bpe import SplitMemo

#: Documents that are packed together: enough that a group wastes a bin at most, few enough for one task.
GROUP = 2048
#: An exchange has to fill the fuller bin by so many tokens at least: smaller steps are many and hardly ever empty a bin.
LEAST_GAIN = 8
CUT = "piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Below this the two libraries' regular expressions see the same letters, digits and spaces.
LATIN = "\u0250"


@functools.cache
def tokenizer(path: str, ranks: str | None = None) -> SplitMemo:
    """Texts to ids of the tokenizer file, as little-endian unsigned 32-bit integers; a special token's string gives its id.

    ranks: a rank file of the same vocabulary. Latin words that a memo lacks are then encoded from it by tiktoken, which
    gives the same ids in a fifth of the time; all others, and texts with odd white space, by tokenizers.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    added = [x.content for x in t.get_added_tokens_decoder().values()]

    def slow(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    if not ranks:
        return SplitMemo(slow, lambda text: slow([text])[0], whole_texts=added)
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary

    def fast(words: list[str]) -> list[bytes]:
        latin = [w.isascii() or max(w) < LATIN for w in words]
        others = iter(slow([w for w, ok in zip(words, latin, strict=True) if not ok]))
        return [array("I", encode(w)).tobytes() if ok else next(others) for w, ok in zip(words, latin, strict=True)]

    return SplitMemo(fast, lambda text: slow([text])[0], whole_texts=added)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of ids): one piece, or a shorter first one and then full ones."""
    n, at, out = len(ids) // 4, 0, []
    while at < n:
        size = n % capacity or capacity if at == 0 else capacity
        out.append((len(out), at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
        at += size
    return out


class Bins:
    """Pieces in bins. Every accepted change raises the sum of squared fills; a bin that loses all its pieces is gone."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.offers: dict[int, tuple[list, list]] = {}
        self._best_fit()

    def _best_fit(self) -> None:
        """Longest first, each into the bin that it leaves fullest."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        some = 0  # bit f: a bin with f free places exists
        for i in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            s = self.sizes[i]
            if fits := some >> s:
                f = s + (fits & -fits).bit_length() - 1
                b = by_free[f].pop()
                if not by_free[f]:
                    some &= ~(1 << f)
                self.bins[b].append(i)
            else:
                f, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.free.append(0)
            self.free[b] = f - s
            by_free[f - s].append(b)
            some |= 1 << (f - s)

    def _change(self, a: int, out: tuple[int, ...], b: int, back: tuple[int, ...]) -> None:
        """Pieces `out` go from bin a to bin b, pieces `back` the other way."""
        gain = sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in back)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + [*back]
        self.bins[b] = [i for i in self.bins[b] if i not in back] + [*out]
        self.free[a] += gain
        self.free[b] -= gain
        self.offers.pop(a, None)
        self.offers.pop(b, None)

    def _step(self, a: int, others: list[int]) -> int | None:
        """Makes a change that fills a fuller bin from bin a, the one that fills it furthest; that bin, or None if there is none.

        others: underfull bins that are as full as a at least, so that any gain raises the sum of squares. Of pieces of one
        size in a bin one stands for all, so a bin offers few sizes and pairs of sizes.
        """
        mine, pairs = self._offers(a)
        free = np.array([self.free[b] for b in others])
        for k in np.argsort(-mine[0]):  # a move
            if len(fit := np.flatnonzero(free >= mine[0][k])):
                target = others[fit[np.argmin(free[fit])]]
                self._change(a, mine[1][k], target, ())
                return target
        offers = [self._offers(b) for b in others]
        for outs, of in ((mine, 0), (pairs, 0), (mine, 1)):  # one for one, two for one, one for two
            size = np.concatenate([o[of][0] for o in offers])
            owner = np.repeat(np.arange(len(others)), [len(o[of][0]) for o in offers])
            if not len(size) or not len(outs[0]):
                continue
            # of pieces of one size, the one in the bin with most room stands for all
            room = np.full(self.capacity + 1, -1)
            np.maximum.at(room, size, free[owner])
            sizes = np.flatnonzero(room >= 0)
            gain = outs[0][:, None] - sizes
            gain[gain > room[sizes]] = 0
            k, j = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[k, j] >= LEAST_GAIN:
                at = int(np.argmax((size == sizes[j]) & (free[owner] == room[sizes[j]])))
                there = owner[at]
                first = at - int(np.argmax(owner == there))
                self._change(a, outs[1][k], others[there], offers[there][of][1][first])
                return others[there]
        return None

    def _offers(self, b: int) -> tuple[tuple[np.ndarray, list], tuple[np.ndarray, list]]:
        """Sizes and pieces of the bin's single pieces and of its pairs, one for each size or pair of sizes; kept until it changes."""
        if b not in self.offers:
            by_size: dict[int, list[int]] = {}
            for i in self.bins[b]:
                by_size.setdefault(self.sizes[i], []).append(i)
            groups = list(by_size.items())
            two = [(s + t, (m[0], n[0])) for k, (s, m) in enumerate(groups) for t, n in groups[k + 1 :]]
            two += [(2 * s, (m[0], m[1])) for s, m in groups if len(m) > 1]
            self.offers[b] = (np.array(list(by_size), np.int64), [(m[0],) for m in by_size.values()]), (np.array([x for x, _ in two], np.int64), [x for _, x in two])
        return self.offers[b]

    def improve(self) -> None:
        """Empties the emptiest bins as long as any change is found; ends early at the number of bins that no packing beats.

        Each change raises the sum of squared fills, which is bounded, so it ends; its steps grow with the number of pieces.
        """
        least = -(-sum(self.sizes) // self.capacity)
        # when a bin was changed, and when it found no change last: until then only bins that have changed since matter to it
        clock, changed, tried = 1, [0] * len(self.bins), [-1] * len(self.bins)
        while len(self.bins) > least:
            order = [b for b in sorted(range(len(self.bins)), key=lambda b: -self.free[b]) if self.free[b]]
            done = True
            for k, a in enumerate(order):
                since = tried[a]
                others = [b for b in order[k + 1 :] if changed[b] > since]
                if others and (target := self._step(a, others)) is not None:
                    done = False
                    clock += 1
                    changed[a] = changed[target] = clock
                    tried[a] = -1
                    break
                tried[a] = clock
            if done:
                return
            if not self.bins[a]:
                last = len(self.bins) - 1
                for x in (self.bins, self.free, changed, tried):
                    x[a] = x[last]
                    x.pop()
                self.offers.pop(a, None)
                self.offers.pop(last, None)


def packed_bins(sizes: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(sizes, capacity)
    bins.improve()
    return bins.bins


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, piece and length (1 to capacity).

    Pieces are dealt by the number of their row into groups of about `group` documents, whatever their ids; each is packed in
    one task, so no task grows with the input, and each wastes part of one bin at most where the lengths mix well. Repeated
    rows and those without an id are pieces of their own; of equal lengths any order will do; an empty table gives an empty
    one. Columns other than sequence_id and offset are kept.
    """
    group_name = C.free_name("group", pieces.columns)
    # written, so that a task that is run again numbers its rows alike
    pieces = C.written(pieces, "pieces")
    groups = max(1, -(-pieces.where("piece = 0").count() // group))

    def packed(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable", ignore_index=True).drop(columns=["sequence_id", "offset"], errors="ignore")
        lengths = rows["length"].to_numpy()
        sequence, offset = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        short = np.flatnonzero(lengths < capacity)
        full = np.flatnonzero(lengths == capacity)
        bins = packed_bins(lengths[short].tolist(), capacity)
        for b, members in enumerate(bins):
            at = short[members]
            sequence[at] = b
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        sequence[full] = len(bins) + np.arange(len(full))
        return rows.assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset).drop(columns=group_name)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("sequence_id", "offset")) + ", sequence_id long, offset long"
    dealt = pieces.withColumn(group_name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy(group_name).applyInPandas(packed, schema)


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end: int = 0, ranks: str | None = None) -> DataFrame:
    """doc_id and the pieces of its text's ids followed by the id `end`: number, start, length and crc32.

    A null text is empty and so has the end id alone; repeated rows give repeated pieces; an empty table gives an empty one.
    A text of any length is encoded whole and then cut.
    """
    C.small_batches(docs.sparkSession)
    where = (path, ranks) if path else (default_tokenizer(), default_ranks())
    last = end.to_bytes(4, "little")
    names = [c.split()[0] for c in CUT.split(", ")]

    def made(texts: pd.Series) -> pd.Series:
        encoded = (ids for part in C.slices([t or "" for t in texts]) for ids in tokenizer(*where)(part))
        return pd.Series([[dict(zip(names, p, strict=True)) for p in cut(ids + last, capacity)] for ids in encoded], dtype=object)

    kind = "array<struct<" + CUT.replace(" ", ":").replace(",:", ",") + ">>"
    return docs.select("doc_id", F.explode(F.pandas_udf(made, kind)("text")).alias("p")).select("doc_id", "p.*")


def packed_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most `capacity` tokens."""
    return pack(pieces(docs, capacity, path), capacity)
