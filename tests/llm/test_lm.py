"""LM scoring against plain Python over the same definition, and the mixture's sum over the vocabulary."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from kartoteka.llm import lm


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 10


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [None]


def counts(rows, keep):
    c, texts, n = Counter(), 0, 0
    for i, t in rows:
        if keep(fold(i)):
            seq = ["<s>", "<s>", *tokens(t)]
            texts, n = texts + 1, n + len(seq) - 2
            for k in range(2, len(seq)):
                for order in (1, 2, 3):
                    c[tuple(seq[k - order + 1 : k + 1])] += 1
    return c, texts, n


def parts(c, texts, n, v, seq, k):
    """Estimates by order, and the context's bucket, of token k of a padded text."""
    e, bucket = [1 / (v + 1), c[tuple(seq[k : k + 1])] / n, 0.0, 0.0], 0
    for order in (2, 3):
        context = texts if k == 2 else c[tuple(seq[k - order + 1 : k])]
        if context:
            e[order] = c[tuple(seq[k - order + 1 : k + 1])] / context
            bucket = 1 + (order - 2) * lm.POWERS + min(int(math.log2(context)), lm.POWERS - 1)
    return e, bucket


def weights(rows, v):
    c, texts, n = counts(rows, lambda f: f not in (0, 1))
    w = lm.first_weights(True)
    data = []
    for i, t in rows:
        if fold(i) == 1:
            seq = ["<s>", "<s>", *tokens(t)]
            data += [parts(c, texts, n, v, seq, k) for k in range(2, len(seq))]
    for _ in range(lm.ROUNDS):
        new = np.zeros(w.shape)
        for e, b in data:
            p = w[b] * np.array(e)
            new[b] += p / p.sum()
        for b in range(len(w)):
            if new[b].sum():
                w[b] = 0.999999 * new[b] / new[b].sum() + 0.000001 * np.eye(4)[0]
    return w


def corpus():
    r = random.Random(4)
    vocab = ["a", "B", "c,", "été", "日本"] + [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(r.choices(vocab, range(len(vocab), 0, -1), k=r.randint(0, 40)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "unseen words only"), (None, "a B"), rows[3]]


def test_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(lm.K, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(lm.K, "BUCKET_BYTES", 2000)
    rows = corpus()
    c, texts, n = counts(rows, lambda f: f != 0)
    v = sum(len(k) == 1 for k in c)
    w = weights(rows, v)
    want = []
    for i, t in rows:
        seq = ["<s>", "<s>", *tokens(t)]
        ks = range(2, len(seq))
        base = sum(math.log10((c[(seq[k],)] + 0.1) / (n + 0.1 * (v + 1))) for k in ks)
        score = sum(math.log10(np.dot(w[b], e)) for e, b in (parts(c, texts, n, v, seq, k) for k in ks))
        want.append((i, fold(i) == 0, len(seq) - 2, sum(c[(seq[k],)] > 0 for k in ks), n, base, score))
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-6)
    # for any context, the mixture over the vocabulary and one unseen word sums to 1
    words = [k for k in c if len(k) == 1]
    for context in (("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("never", "a"), ("never", "seen")):
        total = 0
        for x in [*words, ("zzz",)]:
            seq = ["<s>", "<s>", *[w for w in context if w != "<s>"], x[0]]
            e, b = parts(c, texts, n, v, seq, len(seq) - 1)
            total += np.dot(w[b], e)
        assert abs(total - 1) < 1e-9


def test_empty_and_untrained(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if fold(i) == 0)
    (row,) = lm.scores(spark.createDataFrame([(held, "x y", 1)], "doc_id long, text string, chunk int")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
