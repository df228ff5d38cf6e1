"""Substring dedup against a brute-force version."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from kartoteka.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    words = {k: WORD.findall(t or "") for k, (i, t) in enumerate(rows)}
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is None:
            continue
        for a in range(len(words[k]) - window + 1):
            w = tuple(words[k][a : a + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        gone = set()
        for a in range(len(words[k]) - window + 1):
            if i is not None and first[tuple(words[k][a : a + window])] < i:
                gone |= set(range(a, a + window))
        kept = [w for n, w in enumerate(words[k]) if n not in gone]
        out.append((i, len(words[k]), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Ünï", "日本", "x y"]
    passages = [" ".join(r.choices(vocab, k=n)) for n in (12, 13, 14, 25, 60)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.6 else " ".join(r.choices(vocab, k=r.randint(1, 20))))
        rows.append((i * 3 - 20, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(500 + i, passages[4]) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, "  \n "), (None, passages[3]), (None, None), rows[5], rows[5], (rows[7][0], passages[3])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings.K, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substrings.K, "BUCKET_BYTES", 2000)
    rows = corpus(seed)
    got = substrings.repeated_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def removed_here(rows, parts=3, buckets=4):
    """The operator's steps on chunks in this process."""
    s = substrings
    chunks = [next(s.K._row(0, [i for i, _ in rows[k::parts]], [(t or "").encode() for _, t in rows[k::parts]], None).itertuples()) for k in range(parts)]
    grids = {row.chunk: s._Grid(s.K.Chunk(row), 13) for row in chunks}

    def answered(asked, answer):
        return pd.concat([answer(g.reset_index(drop=True)) for _, g in pd.concat(asked).groupby("bucket")])

    anchors = answered([s._ask_blocks(g, c, buckets) for c, g in grids.items()], s._anchors)
    of = lambda table, c: table[table["chunk"] == c]
    holders = answered([s._ask_windows(g, c, of(anchors, c), buckets) for c, g in grids.items()], s._first_holders)
    both = pd.concat([anchors, holders])
    out = []
    for c, g in grids.items():
        gone, sha = s._digest(s.K.Chunk(next(r for r in chunks if r.chunk == c)).texts, g.counts, s._removed(g, of(both, c), buckets))
        ids = [None if n else int(i) for i, n in zip(g.ids, g.no_id, strict=True)]
        out += zip(ids, g.counts.tolist(), gone, sha, strict=True)
    return sorted(out, key=str)


def test_windows_whose_keys_are_equal_by_chance_stay_apart(monkeypatch):
    rows = corpus(4)
    assert removed_here(rows) == brute(rows)
    real = substrings._Grid.window_hashes

    def meeting(self, at):
        keys, checks = real(self, at)
        return keys & np.uint64(0xC000000000000001), checks  # eight keys for all windows

    monkeypatch.setattr(substrings._Grid, "window_hashes", meeting)
    assert removed_here(rows) == brute(rows)


def test_maximal_repeats(spark):
    words = [f"a{k}" for k in range(40)]
    rows = [
        (1, " ".join(words)),
        (2, "x " + " ".join(words[5:30]) + " y z " + " ".join(words[10:22]) + " " + " ".join(words[20:33])),
        (3, " ".join(words[27:])),
        (3, " ".join(words[27:])),
        (4, " ".join(words[28:])),
        (5, None),
        (6, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substrings.maximal_repeats(df).collect()))
    # words 10 to 21 are one too few; 20 to 32 are just enough
    assert got == [(2, 1, 25), (2, 40, 13), (3, 0, 13), (3, 0, 13)]
    assert substrings.maximal_repeats(df.limit(0)).collect() == []


def test_texts_lose_those_words_only(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, n_chars long, chunk string")
    got = substrings.without_repeats(df)
    assert got.columns == df.columns
    out = [(r.doc_id, r.text) for r in got.collect()]
    want = sorted((i, sha) for i, _, _, sha in brute(rows) if i is not None)
    assert sorted((i, hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest()) for i, t in out if i is not None) == want
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)
    assert {t for i, t in out if i == 1000} == {None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.repeated_words(df).collect() == []
    assert substrings.without_repeats(df).collect() == []
