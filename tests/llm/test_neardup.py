"""Near-duplicates: recall of the trees on signatures and texts, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from kartoteka.llm import neardup


def test_deepest_level_misses_as_few_as_stated(spark, monkeypatch):
    """5000 pairs of similarity 0.7 whose nodes all count as large: branches drawn by the node miss about 1 of them, the same for all nodes 37."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    pairs, r = 5000, np.random.default_rng(8)
    a = r.integers(-(1 << 31), 1 << 31, (pairs, neardup.TOKENS)).astype(np.int32)
    b = np.where(r.random(a.shape) < 0.7, a, r.integers(-(1 << 31), 1 << 31, a.shape).astype(np.int32))
    ids = np.arange(pairs)
    rows = spark.createDataFrame(pd.DataFrame({"doc_id": np.r_[2 * ids, 2 * ids + 1], "sig": [*a.tolist(), *b.tolist()]}), "doc_id long, sig array<int>")
    _, stars = neardup.leaves(rows)
    met = stars.where("a = b + 1 and b % 2 = 0").distinct().count()
    assert pairs - met <= 8


def test_large_nodes_of_unlike_sets_are_branched_until_small(spark):
    """400 sets share the tokens of all roots and little else: at the third level many nodes would still be large."""
    r = np.random.default_rng(3)
    sig = np.where(r.random((400, neardup.TOKENS)) < 0.35, 7, r.integers(-(1 << 31), 1 << 31, (400, neardup.TOKENS))).astype(np.int32)
    sig[:, : neardup.TREES * neardup.CHOSEN[0]] = 7
    rows = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(400), "sig": sig.tolist()}), "doc_id long, sig array<int>")
    _, stars = neardup.leaves(rows)
    equal = {(i, j): int((sig[i, : neardup.COMPARED] == sig[j, : neardup.COMPARED]).sum()) for i, j in [(x.a, x.b) for x in stars.collect()]}
    assert all(n >= neardup.LEAST_EQUAL for n in equal.values())


def test_group_of_many_blocks_equals_one(spark, monkeypatch):
    """Near copies with one to 40 of 120 words changed, dealt into many blocks and chunks."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    r = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in r.sample(range(120), r.choice((1, 3, 6, 10, 14, 20, 40))):
            words[at] = f"x{r.randrange(60)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 2)
    assert len(set(want.values())) > 10
    for block in (neardup.BLOCK, 4000):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = neardup.near_duplicates(docs, k=2).collect()
        assert {x.doc_id: x.component_id for x in got} == want


def brute(rows, k, least=80):
    """Components by all pairs of full sets."""
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split() if text else []
        sets[i] = {tuple(w[a : a + min(k, len(w))]) for a in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if label[i] != label[j] and sets[i] and len(sets[i] & sets[j]) * 100 >= least * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {x: a if c == b else c for x, c in label.items()}
    return label


@pytest.mark.parametrize("k", [2, 5])
def test_recall_on_the_documents_table(spark, k):
    """All links of 1000 documents, by all pairs; at least 0.9 of them, here all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, k)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs, k=k).collect()}
    assert got == want
    assert sum(i != c for i, c in want.items()) > 10


def test_edges_of_the_contract(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "A b", 0), (5, "a B", 0), (5, "a b", 0), (6, "one", 0), (7, "one", 0), (None, "one", 0), (8, "z " * 50_000, 0), (9, "Z " * 50_000, 0)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, sig int"), k=2).collect()
    assert sorted([tuple(x) for x in got], key=str) == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False),
        (6, 1, 6, True), (7, 1, 6, False), (None, 1, 6, False), (8, 1, 8, True), (9, 1, 8, False),
    ], key=str)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), k=2).collect() == []


def test_pairs_at_the_threshold_among_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    r = random.Random(6)
    common = [f"c{i} d{i} e{i}" for i in range(12)]
    rows = []
    for i in range(300):
        words = [" ".join(r.choices(common, k=4)), *(f"w{r.randrange(10**6)}" for _ in range(50))]
        other = words[: -r.randint(2, 14)] + [f"x{r.randrange(10**6)}" for _ in range(r.randint(0, 3))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[k : k + 2]) for k in range(len(w) - 1)})
    want = {}
    for i, s in enumerate(sets):
        want[i] = next((j for j in range(i) if len(s & sets[j]) * 100 >= 80 * len(s | sets[j])), i)
    assert 50 < sum(i != j for i, j in want.items()) < 300
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=2).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_large_node_with_few_unlike_its_least_is_done(spark, monkeypatch):
    """300 sets that have 18 of 32 tokens of the least one, and pairs of outsiders: one level gathers all that branches would."""
    r = np.random.default_rng(5)
    n = 300
    new = lambda *shape: r.integers(-(1 << 31), 1 << 31, shape).astype(np.int32)
    sig = new(n + 4, neardup.TOKENS)
    sig[:, 0] = 7
    for i in range(1, n):
        same = r.choice(np.arange(1, neardup.COMPARED), 17, replace=False)
        sig[i, same] = sig[0, same]
    sig[n, 9:28] = sig[5, 9:28]  # outsiders like one member, like each other, and like none
    sig[n + 2, 10:26] = sig[n + 1, 10:26]
    rows = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n + 4), "sig": sig.tolist()}), "doc_id long, sig array<int>")
    made, written = [], neardup.C.written

    def counted(df, name, *more):
        out = written(df, name, *more)
        if name == "level":
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup.C, "written", counted)
    label = {i: i for i in range(n + 4)}
    edges = [(x.a, x.b) for x in neardup.candidates(rows, n).collect()]
    for a, b in edges * 3:
        label[a] = label[b] = min(label[a], label[b])
    assert all(label[i] == 0 for i in range(n + 1))
    assert label[n + 1] == label[n + 2] == n + 1 and label[n + 3] == n + 3
    assert made[0] > n and not any(made[1:])
