"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of the inner products of their factors): the pair part finds an
insult next to a group's name, where each alone says little. Terms are hashes of words and of their first letters; a
document's features are the distinct terms of its whole text. Every term of the training documents has a weight and factors;
how strongly it counts is set by how surely its share differs between the labels, so that rare terms are not learned by heart.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C

WORD = re.compile(r"[^\W\d_]+")
#: Terms are hashed into so many places.
PLACES = 1 << 20
FACTORS = 8
#: Bound of the labelled documents of each label that the model is fitted on, whole texts each; drawn by a hash of the id.
TRAIN_ROWS = 3000
#: A term counts LEAST_SCALE + z^2 / (z^2 + SURE); z: deviation of its documents of label 1 from what chance gives.
LEAST_SCALE, SURE = 0.02, 64.0
#: Passes over the training documents, documents of a step, size of a step; few documents get more passes, to LEAST_STEPS.
EPOCHS, BATCH, RATE = 6, 256, 1.0
LEAST_STEPS = 150

#: A word's terms: itself and its first so many letters, as stems are inflected.
STEMS = (3, 4, 5, 6)


def word_terms(words: list[str]) -> np.ndarray:
    """The hashed places of each word's terms, one row each."""
    h = xxhash.xxh3_64_intdigest
    return np.array([[h(w), *(h(w[:k] + "~") for k in STEMS)] for w in words], np.uint64).reshape(len(words), 1 + len(STEMS)).astype(np.int64) & (PLACES - 1)


def distinct_words(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of all texts, and (row, place among these words) of the distinct ones of each text, by row."""
    split = [dict.fromkeys(WORD.findall(t.lower())) if t else () for t in texts]
    number: dict[str, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64)
    return list(number), np.repeat(np.arange(len(split)), np.fromiter(map(len, split), np.int64, len(split))), word


def _sums(values: np.ndarray, starts: np.ndarray, n: int | None = None, rows: np.ndarray | None = None) -> np.ndarray:
    """Sums of consecutive runs of values; with n and rows: put at these rows of n, others are 0."""
    out = np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]
    if n is None:
        return out
    full = np.zeros((n, *values.shape[1:]), values.dtype)
    full[rows] = out
    return full


class Machine:
    """Weights, factors and scales of the terms in `kept` (ascending); other terms count nothing.

    A document's features are the terms of its distinct words: a stem that several of them have stands there as often. Their
    vector has length 1. base: the margin of a text without any known term.
    """

    def __init__(self, kept: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray, scale: np.ndarray, base: float):
        self.kept, self.bias, self.w, self.v, self.scale, self.base = kept, bias, w, v, scale, base
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.empty((1 << 12, FACTORS + 3), np.float32)

    def __reduce__(self):
        return Machine, (self.kept, self.bias, self.w, self.v, self.scale, self.base)

    def of_words(self, words: list[str]) -> np.ndarray:
        """For each word, sums over its known terms: of weights, of factors, of squares of the latter, of squared scales."""
        term = word_terms(words)
        at = np.minimum(np.searchsorted(self.kept, term), max(0, len(self.kept) - 1))
        known = self.kept[at] == term if len(self.kept) else np.zeros(term.shape, bool)
        at = np.where(known, at, 0)
        x = np.where(known, self.scale[at], 0) if len(self.kept) else np.zeros(term.shape)
        if not len(self.kept):
            return np.zeros((len(words), FACTORS + 3), np.float32)
        v = self.v[at] * x[..., None]
        return np.column_stack([(self.w[at] * x).sum(1), v.sum(1), (v**2).sum((1, 2)), (x**2).sum(1)]).astype(np.float32)

    def margin(self, row: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
        """The margins of n documents; row: which each of the sums belongs to, ascending."""
        rows, starts = np.unique(row, return_index=True)
        s = _sums(sums.astype(np.float64), starts, n, rows)
        square = np.maximum(s[:, -1], 1e-12)
        out = self.bias + s[:, 0] / np.sqrt(square) + ((s[:, 1:-2] ** 2).sum(1) - s[:, -2]) / square / 2
        return np.where(s[:, -1] > 0, out, self.base)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        C.claim(self)
        words, row, word = distinct_words(texts)
        if len(self.rows) > C.MEMO:
            self.forget()
        new = [w for w in words if w not in self.rows]
        first = len(self.rows)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[first : first + len(new)] = self.of_words(new)
        self.rows.update(zip(new, range(first, first + len(new)), strict=True))
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        margin = self.margin(row, self.table[at[word]], len(texts))
        if any(len(w) > C.MEMO_BYTES for w in new):  # a memo of long words would not be bounded in bytes
            self.forget()
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def scales(table: np.ndarray, word: np.ndarray, positive: np.ndarray, share: float, n: int) -> np.ndarray:
    """How strongly each of n terms counts, from where its words stand, and where that is in documents of label 1 (positive).

    table: the terms of each word; word: the distinct words of all documents.
    """
    counts = np.stack([np.bincount(word, minlength=len(table)), np.bincount(word[positive], minlength=len(table))])
    both, ones = (np.bincount(table.reshape(-1), np.repeat(c, table.shape[1]), n) for c in counts)
    z2 = (ones - both * share) ** 2 / (both * share * (1 - share) + 1)
    return (LEAST_SCALE + z2 / (z2 + SURE)).astype(np.float32)


def trained(words: list[str], word: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss over documents given by their distinct words (places in words), one after the other.

    sizes: distinct words of each document. Both labels weigh the same in sum. A step touches the terms of its documents only,
    so time grows with the documents' words, and memory holds these once.
    """
    rng, n = np.random.default_rng(5), len(y)
    places = word_terms(words)
    there = np.zeros(PLACES, bool)
    there[places] = True
    kept = np.flatnonzero(there)
    table = (np.cumsum(there, dtype=np.int32) - 1)[places]
    scale = scales(table, word, np.repeat(y == 1, sizes), y.mean(), len(kept))
    m = Machine(kept, 0.0, np.zeros(len(kept), np.float32), rng.normal(0, 0.05, (len(kept), FACTORS)).astype(np.float32), scale, float(np.log(y.mean() / (1 - y.mean()))))
    sums_w, sums_v, sum_b = np.ones(len(kept), np.float32), np.ones((len(kept), FACTORS), np.float32), 1.0
    weight = np.where(y == 1, n / 2 / max(1, (y == 1).sum()), n / 2 / max(1, (y == 0).sum()))
    ends = np.cumsum(sizes)
    order = rng.permutation(np.flatnonzero(sizes))
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(order))))):
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            own_terms = table[np.concatenate([word[ends[i] - sizes[i] : ends[i]] for i in rows])].reshape(-1)
            k = sizes[rows] * table.shape[1]
            starts = np.cumsum(k) - k
            by_term = np.argsort(own_terms, kind="stable")
            row = np.repeat(np.arange(len(rows)), k)[by_term]
            used, first = np.unique(own_terms[by_term], return_index=True)
            x = scale[own_terms]
            length = (1 / np.sqrt(_sums(x * x, starts))).astype(np.float32)
            v = m.v[own_terms] * x[:, None]
            s = _sums(v, starts) * length[:, None]
            z = m.bias + _sums(m.w[own_terms] * x, starts) * length + ((s**2).sum(1) - _sums((v**2).sum(1), starts) * length**2) / 2
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * weight[rows]).astype(np.float32)
            # of a term: its documents' errors, times what its weight and its factors add there
            gx, own = g * length, scale[used]
            gw = _sums(gx[row], first) * own + decay * len(rows) * m.w[used]
            gv = _sums((gx[:, None] * s)[row], first) * own[:, None] - (_sums((gx * length)[row], first) * own**2)[:, None] * m.v[used] + decay * len(rows) * m.v[used]
            sums_w[used] += gw**2
            sums_v[used] += gv**2
            sum_b += float(g.sum()) ** 2
            m.w[used] -= rate * gw / np.sqrt(sums_w[used])
            m.v[used] -= 0.3 * rate * gv / np.sqrt(sums_v[used])
            m.bias -= rate * float(g.sum()) / sum_b**0.5
    return m


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Machine:
    """Learns from docs (doc_id, text) that labels (doc_id, toxic: 0 or 1) mark; nulls in any of these are left out.

    Of each label about max_rows ids at most are drawn by a hash of the id, on the labels alone; only their documents are
    looked up, by a broadcast whose size max_rows bounds. Equal texts count once, as toxic if any of them is. Without
    documents of both labels the score is that label's, or 0 without any.
    """
    C.small_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    marks = C.written(marks, "marks")
    there = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("_toxic") == 1, F.lit(max_rows / there.get(1, 1))).otherwise(F.lit(max_rows / there.get(0, 1)))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) < share * float(1 << 40))

    def distinct(batches):
        for b in batches:
            for texts, rows in C.parts(b, "text"):
                words, row, word = distinct_words(texts)
                ends = np.cumsum(np.bincount(row, minlength=len(texts)))[:-1]
                found = [x.tolist() for x in np.split(np.array(words, object)[word], ends)]
                yield pd.DataFrame({"y": rows["_toxic"].to_numpy(), "h": [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], "words": found})

    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "_toxic")
    sets = rows.mapInPandas(distinct, "y int, h long, words array<string>").groupBy("h").agg(F.max("y").alias("y"), F.first("words").alias("words"))
    data = sets.toArrow().sort_by("h")  # words as Arrow holds them, not as Python objects
    lists = data["words"].combine_chunks()
    found = lists.flatten().dictionary_encode()
    y, sizes = data["y"].to_numpy().astype(float), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if len(set(y)) < 2 or not sizes.sum():
        base = 40.0 if len(y) and y.mean() > 0.5 else -40.0
        return Machine(np.empty(0, np.int64), base, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32), np.zeros(0, np.float32), base)
    return trained(found.dictionary.to_pylist(), found.indices.to_numpy(), sizes, y)


def score(df: DataFrame, machine: Machine, text: str | Column = "text", to: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of each row's whole text; null and empty texts, and those without a term of the
    training documents, get the share of toxic ones among these.

    All rows stay, equal texts get equal scores; an existing column of the name `to` is replaced. An empty table stays one.
    Long texts are scored whole.
    """
    C.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(machine)  # terms of TRAIN_ROWS documents of each label, PLACES at most

    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.empty(0), *(shared.value.scores(part) for part in C.slices(texts))]))

    return df.withColumn(to, F.pandas_udf(made, "double")(F.col(text) if isinstance(text, str) else text))


def held_out(doc_id: str = "doc_id") -> Column:
    return C.id_crc(doc_id) % 5 == 0


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learned from labelled rows that are not held out."""
    machine = fit(docs.where(~held_out()), labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
