"""The factorization machine against dense sums over pairs, a pair that weights alone miss, and held-out labels."""

import random

import numpy as np

from kartoteka.llm import toxicity


def test_margin_equals_the_sum_over_all_pairs():
    texts = ["", None, "vile", "a fine day, running runner", "you vile fools, you!", "12 34", "unknown"]
    r = np.random.default_rng(1)
    kept = np.unique(toxicity.word_terms([w for t in texts[:6] for w in toxicity.WORD.findall((t or "").lower())]))
    n = len(kept)
    m = toxicity.Machine(kept, 0.3, r.normal(size=n), r.normal(size=(n, 8)), r.random(n) + 0.1, -1.5)
    want = []
    for t in texts:
        places = toxicity.word_terms(sorted(set(toxicity.WORD.findall((t or "").lower())))).reshape(-1)
        s = [int(np.searchsorted(kept, p)) for p in places if p in kept]
        if not s:
            want.append(-1.5)
            continue
        x = [m.scale[k] / np.sqrt(sum(m.scale[j] ** 2 for j in s)) for k in s]
        pairs = sum(m.v[s[a]] @ m.v[s[b]] * x[a] * x[b] for a in range(len(s)) for b in range(a))
        want.append(0.3 + sum(m.w[k] * y for k, y in zip(s, x, strict=True)) + pairs)
    assert np.allclose(m.scores(texts), 1 / (1 + np.exp(-np.array(want))), atol=1e-6)
    assert np.allclose(m.scores(texts[::-1])[::-1], 1 / (1 + np.exp(-np.array(want))), atol=1e-6)  # from the memo


def test_a_pair_is_found_that_weights_alone_miss():
    """Two words are as frequent in both labels; only together, or both absent, they mean label 1."""
    r = random.Random(3)
    texts, y = [], []
    for i in range(800):
        a, b = i % 2, i // 2 % 2
        texts.append(" ".join([("insult", "praise")[a], ("groupname", "nobody")[b], *r.sample([f"filler{chr(97 + k)}" for k in range(26)], 3)]))
        y.append(float(a == b))
    words = sorted({w for t in texts for w in t.split()})
    y = np.array(y)
    m = toxicity.trained(words, np.array([words.index(w) for t in texts for w in t.split()]), np.full(len(texts), 5), y, epochs=40)
    assert ((m.scores(texts) > 0.5) == (y == 1)).mean() > 0.95
    m.v[:] = 0  # without pairs
    m.forget()
    assert ((m.scores(texts) > 0.5) == (y == 1)).mean() < 0.7


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity_of_documents(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").toPandas()
    assert ((got["toxic"] == 1) & (got["predicted"] == 1)).sum() >= 0.9 * (got["toxic"] == 1).sum()
    assert ((got["toxic"] == 0) & (got["predicted"] == 1)).sum() <= 0.01 * (got["toxic"] == 0).sum()


def test_edges(spark):
    docs = spark.createDataFrame([(i, "you vile fool" if i % 2 else "a fine day", 1) for i in range(1, 60)] + [(None, "vile", 1), (100, None, 1), (101, "", 1), (102, "vile fool " * 30_000, 1), (3, "you vile fool", 1), (71, "so so", 1), (72, "so so", 1)], "doc_id long, text string, score int")
    marks = [(i, i % 2) for i in range(1, 60)] + [(1, None), (2, 7), (None, 1), (100, 1), (999, 1), (71, 1), (72, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity_of_documents(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[100].score == by[101].score and by[102].predicted == 1 and by[5].predicted == 1 and by[6].predicted == 0
    assert by[1].score == by[3].score
    # equal texts with contrary labels count as toxic, whichever is read first
    assert toxicity.toxicity_of_documents(docs.repartition(5), labels).where("doc_id = 1").first().score == by[1].score
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity_of_documents(docs, none).collect()} == {0}
    assert toxicity.toxicity_of_documents(docs.limit(0), labels).collect() == []
