"""Language ID against all segmentations of a word, and held-out accuracy."""

import itertools
import math

import numpy as np
import pytest

from kartoteka.llm import langid


@pytest.fixture(scope="module")
def path():
    return langid.default_vocabulary()


def segmentations(word, pieces):
    """Every way to cut the word into pieces, as ids; a character that is no piece is 0."""
    for n in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), n):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)), strict=True)]
            ids = [pieces.get(p, 0 if len(p) == 1 else None) for p in parts]
            if None not in ids:
                yield ids


def table(path, langs=2):
    size = len(langid.vocabulary(path)[0]) + 1
    p = np.random.default_rng(2).random((size + 1, langs))
    p[-1] = 0
    return p / p.sum(0)


def test_word_probability_is_the_sum_over_all_segmentations(path):
    pieces, _ = langid.vocabulary(path)
    p = table(path)
    words = ["▁the", "▁straße", "▁xq", "▁été", "▁日本", "▁intere"]
    got = langid.word_scores(words, p, path)
    for w, row in zip(words, got, strict=True):
        want = sum(np.prod(p[ids], axis=0) for ids in segmentations(w, pieces))
        assert np.allclose(np.exp(row), want)


def test_expected_uses_are_weighted_over_all_segmentations(path):
    pieces, _ = langid.vocabulary(path)
    p = table(path)
    words, counts, model = ["▁the", "▁intere", "▁été", "▁the"], np.array([3.0, 1.0, 2.0, 1.0]), np.array([0, 1, 1, 1])
    want = np.zeros(p.shape)
    for w, n, m in zip(words, counts, model, strict=True):
        ways = [(ids, math.prod(p[ids, m])) for ids in segmentations(w, pieces)]
        total = sum(q for _, q in ways)
        for ids, q in ways:
            for i in ids:
                want[i, m] += n * q / total
    assert np.allclose(langid.expected(words, counts, p, model, path), want)


def test_long_words_are_learned_from_and_scored(path):
    p = table(path)
    word = "▁" + "donaudampfschiff" * 200
    use = langid.expected([word], np.array([1.0]), p, np.array([0]), path)
    pieces, _ = langid.vocabulary(path)
    length = {i: len(x) for x, i in pieces.items()} | {0: 1}
    assert sum(length[i] * use[i, 0] for i in np.flatnonzero(use[:, 0])) == pytest.approx(len(word))
    assert np.isfinite(langid.word_scores([word], p, path)).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.language_of_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_edges_and_rare_languages(spark):
    rows = [(i, "the cat and the dog of the house", "en", 0) for i in range(60)] + [(100 + i, f"der hund und die katze {'ab' * i}", "de", 0) for i in range(6)]
    rows += [(200, None, "en", 0), (201, "", None, 0), (202, "12 34 !", "en", 0), (203, "der hund", None, 0), (204, "the house " * 20_000, None, 0), (204, "the house", None, 0), (None, "der", None, 0), (205, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _said int")
    model = langid.fit(df, max_rows=3)
    assert model.langs == ["de", "en"] and model.prior[1] > 0.8
    got = langid.predict(df, model)
    assert got.columns == [*df.columns, "lang_pred", "score"] and got.count() == len(rows)
    by = {(r.doc_id, len(r.text or "")): r for r in got.collect()}
    assert [by[k].lang_pred for k in [(200, 0), (201, 0), (202, 7), (203, 8), (204, 200_000), (204, 9)]] == ["und", "und", "und", "de", "en", "en"]
    assert by[200, 0].score == 0 and 0 <= by[203, 8].score <= 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.language_of_documents(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert langid.language_of_documents(unlabelled).count() == 1
