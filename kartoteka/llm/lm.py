"""LM scoring by deleted interpolation of n-gram maximum-likelihood estimates.

p(w | u v) mixes the trigram, bigram and unigram estimates c(uvw)/c(uv), c(vw)/c(v), c(w)/N and the uniform 1/(V+1). The
weights depend on how often the context was seen, by powers of two. They are learned by expectation-maximisation: training
documents are divided into a fitting and a deleted part; estimates from the former's counts are mixed so that the latter's
tokens become likeliest. The model then uses the counts of both.

Counts and statistics cover the whole corpus. Chunks of documents ask for the counts of their distinct n-grams, so a
frequent one costs an entry a chunk, and nothing but the weights' sums and a few totals reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C
from kartoteka.llm import chunks as K

ORDER = 3
#: Context-frequency buckets of each order: floor(log2(count)), the last for all higher.
POWERS = 20
ROUNDS = 8
#: A training document is deleted from the fitting part if crc32(doc_id) mod FOLDS is DELETED; 0 is never trained on.
FOLDS, DELETED = 10, 1
#: Parts of the documents, which are in different chunks.
FIT_PART, DELETED_PART, HELD_OUT_PART = 0, 1, 2
ASK = "bucket int, chunk long, part int, keys binary, n binary"
COUNTS = "chunk long, part int, bucket int, fit binary, whole binary, distinct long"
#: Hashes of the start of a text and of its end, which no word has but by chance.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class _Tokens:
    """A chunk's tokens: every document's words and then the end; n-grams of each order by position."""

    def __init__(self, chunk: K.Chunk):
        words, n = chunk.words, chunk.sizes
        self.sizes = n + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(n)), self.sizes)
        self.words = np.full(int(self.sizes.sum()), END, np.uint64)
        is_word = np.ones(len(self.words), bool)
        is_word[self.starts + n] = False
        self.words[is_word] = words

    def grams(self, order: int) -> np.ndarray:
        """Hash of the last `order` tokens at each position; positions before a text's first are its start."""
        h = np.full(len(self.words), 0x9E3779B97F4A7C15 + order, np.uint64)
        into = np.arange(len(self.words)) - self.starts[self.doc]
        for back in range(order - 1, -1, -1):
            t = np.where(into >= back, np.r_[np.zeros(back, np.uint64), self.words[: len(self.words) - back]], START)
            h = C.mixed(h * np.uint64(0xD6E8FEB86659FD93) + t)
        return h


def _ask(chunk: K.Chunk, buckets: int, orders: tuple[int, ...]) -> pd.DataFrame:
    """The chunk's distinct n-grams, how often each stands there; bucket: in the order's own range."""
    tokens, row = _Tokens(chunk), chunk.row
    out = []
    for order in orders:
        keys, n = np.unique(tokens.grams(order), return_counts=True)
        n = n.astype(np.uint32)
        out += [((order - 1) * buckets + k, row.chunk, row.part, C.packed(keys[s], True), C.packed(n[s])) for k, s in K.sent(keys, buckets)]
    return pd.DataFrame(out, columns=["bucket", "chunk", "part", "keys", "n"])


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """The corpus's counts of each chunk's n-grams, and once the number of distinct ones that training has.

    whole: in all training documents; fit: in those that are not deleted, which the deleted chunks alone need.
    """
    keys = [C.unpacked(k, np.uint64, True) for k in rows["keys"]]
    distinct, place = K.merged(keys)
    part = np.repeat(rows["part"].to_numpy(), [len(k) for k in keys])
    n = np.concatenate([C.unpacked(x, np.uint32) for x in rows["n"]])
    fit, whole = (np.bincount(place, np.where(np.isin(part, parts), n, 0), len(distinct)).astype(np.int64) for parts in ([FIT_PART], [FIT_PART, DELETED_PART]))
    ends = np.cumsum([len(k) for k in keys])
    own = [place[e - len(k) : e] for e, k in zip(ends, keys, strict=True)]
    known = np.zeros(len(rows), np.int64)
    known[0] = (whole > 0).sum()
    fits = [C.packed(fit[at]) if p == DELETED_PART else None for at, p in zip(own, rows["part"], strict=True)]
    return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"].astype("int32"), "bucket": rows["bucket"].astype("int32"), "fit": fits, "whole": [C.packed(whole[at]) for at in own], "distinct": known})


def _counts(tokens: _Tokens, answers: pd.DataFrame, which: str, buckets: int) -> np.ndarray:
    """Counts of the n-grams at each token, by order."""
    found = dict(zip(answers["bucket"], answers[which], strict=True))
    out = np.zeros((ORDER, len(tokens.words)), np.int64)
    for order in range(1, ORDER + 1):
        keys, place = np.unique(tokens.grams(order), return_inverse=True)
        n = np.empty(len(keys), np.int64)
        for k, s in K.sent(keys, buckets):
            n[s] = C.unpacked(found[(order - 1) * buckets + k], np.int64)
        out[order - 1] = n[place]
    return out


def estimates(c: np.ndarray, starts: np.ndarray, totals: tuple[int, int], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimates[order, token], bucket[token]): order 0 is the uniform one.

    c: counts by order and token. A token's context of k words is what the order k counts at the token before it; at a text's
    start it is seen as often as there are texts. totals: tokens, texts.
    """
    tokens, texts = totals
    n = c.shape[1]
    e = np.zeros((ORDER + 1, n))
    e[0] = 1 / (vocabulary + 1)
    if tokens:
        e[1] = c[0] / tokens
    bucket = np.zeros(n, np.int64)
    for order in range(2, ORDER + 1):
        context = np.r_[0, c[order - 2][:-1]] if n else np.empty(0, np.int64)
        context[starts] = texts
        seen = context > 0
        e[order, seen] = c[order - 1, seen] / context[seen]
        power = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), POWERS - 1)
        bucket = np.where(seen, 1 + (order - 2) * POWERS + power, bucket)
    return e, bucket


def first_weights(trained: bool) -> np.ndarray:
    """weights[bucket, order]: even among the orders whose context the bucket has seen."""
    w = np.zeros((1 + (ORDER - 1) * POWERS, ORDER + 1))
    for b in range(len(w)):
        top = 1 if b == 0 else 2 + (b - 1) // POWERS
        w[b, : top + 1] = 1 / (top + 1)
    if not trained:
        w[:] = np.eye(ORDER + 1)[0]
    return w


def learned_weights(chunks: DataFrame, counts: DataFrame, buckets: int, totals: tuple[int, int], vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by expectation-maximisation on the deleted documents' tokens, with the counts of the fitting ones.

    Each round is a pass over the deleted tokens' estimates, which are written once; a round returns one sum for each bucket
    and order. A bucket that no deleted token has keeps the even weights.
    """
    w = first_weights(totals[0] > 0)
    if not totals[0]:
        return w

    def deleted(chunk: K.Chunk, found: pd.DataFrame) -> pd.DataFrame:
        tokens = _Tokens(chunk)
        e, bucket = estimates(_counts(tokens, found, "fit", buckets), tokens.starts, totals, vocabulary)
        return pd.DataFrame([(bucket.astype(np.uint8).tobytes(), e[1:].astype(np.float32).tobytes())], columns=["bucket", "e"])

    own = F.col("part") == DELETED_PART
    table = C.written(K.together(chunks.where(own), counts.where(own), deleted, "bucket binary, e binary"), "deleted")
    shape = w.shape
    for _ in range(rounds):

        def shares(batches, w=w):
            out = np.zeros(shape)
            for b in batches:
                for at, e in zip(b["bucket"], b["e"], strict=True):
                    bucket = np.frombuffer(at, np.uint8).astype(np.int64)
                    p = np.empty((ORDER + 1, len(bucket)))
                    p[0] = 1 / (vocabulary + 1)
                    p[1:] = np.frombuffer(e, np.float32).reshape(ORDER, -1)
                    p *= w.T[:, bucket]
                    p /= np.maximum(p.sum(0), 1e-300)
                    for k in range(shape[1]):
                        out[:, k] += np.bincount(bucket, p[k], shape[0])
            i, k = np.nonzero(out)
            yield pd.DataFrame({"i": i, "k": k, "n": out[i, k]})

        sums = table.mapInPandas(shares, "i long, k long, n double").groupBy("i", "k").agg(F.sum("n").alias("n")).toPandas()
        new = np.zeros(shape)
        new[sums["i"], sums["k"]] = sums["n"]
        some = new.sum(1) > 0
        new[some] /= new[some].sum(1, keepdims=True)
        # the uniform part never vanishes, so that each token keeps a probability
        new[some] = 0.999999 * new[some] + 0.000001 * np.eye(shape[1])[0]
        w = np.where(some[:, None], new, w)
    return w


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of doc_id and text.

    Learned from documents whose crc32(doc_id as text) mod 10 is not 0; a null id counts as 0 and so is held out. A null or
    empty text is one end. base_score: log10 of additively smoothed unigrams; score: log10 of the mixture. Without any
    training document both are uniform. Repeated rows are documents of their own; an empty table gives an empty one.
    """
    fold = C.id_crc("doc_id") % FOLDS
    part = F.when(fold == 0, HELD_OUT_PART).when(fold == DELETED, DELETED_PART).otherwise(FIT_PART)
    chunks, buckets = K.chunked(docs, lower=True, part=part)

    def asked(orders: tuple[int, ...]) -> DataFrame:
        def ask(batches):
            for b in batches:
                for row in b.itertuples():
                    yield _ask(K.Chunk(row), buckets, orders)

        return chunks.mapInPandas(ask, ASK)

    # one after the other, as the shuffle of one half is gone before the other's
    lower, highest = (K.answered(asked(orders), _count, COUNTS, "counts", buckets * len(orders)) for orders in (tuple(range(1, ORDER)), (ORDER,)))
    counts = lower.unionByName(highest)
    texts = {r["part"]: (r["t"] + r["d"], r["d"]) for r in chunks.groupBy("part").agg(F.sum("n_words").alias("t"), F.sum("n_docs").alias("d")).collect()}
    fit, cut = texts.get(FIT_PART, (0, 0)), texts.get(DELETED_PART, (0, 0))
    vocabulary = int(counts.where(F.col("bucket") < buckets).agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0])
    weights = learned_weights(chunks, counts, buckets, fit, vocabulary)
    whole = (fit[0] + cut[0], fit[1] + cut[1])

    def scored(chunk: K.Chunk, found: pd.DataFrame) -> pd.DataFrame:
        tokens = _Tokens(chunk)
        c = _counts(tokens, found, "whole", buckets)
        e, bucket = estimates(c, tokens.starts, whole, vocabulary)
        p = np.zeros(c.shape[1])
        for order in range(ORDER + 1):
            p += weights[:, order][bucket] * e[order]
        base = np.log10((c[0] + 0.1) / (whole[0] + 0.1 * (vocabulary + 1)))
        sums = [np.add.reduceat(x, tokens.starts) for x in ((c[0] > 0).astype(np.int64), base, np.log10(p))]
        n = len(tokens.sizes)
        return pd.DataFrame({"doc_id": chunk.doc_ids(), "held_out": chunk.row.part == HELD_OUT_PART, "n_tokens": tokens.sizes, "n_known": sums[0], "train_tokens": np.full(n, whole[0]), "base_score": sums[1], "score": sums[2]})

    return K.together(chunks, counts.drop("fit"), scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
