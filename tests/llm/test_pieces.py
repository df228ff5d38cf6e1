"""SentencePiece by chunks against the library on whole texts."""

import hashlib
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kartoteka.llm import _common as C
from kartoteka.llm import pieces

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   ", "\n", "\n\n", " \n ", "a\nb", "a \n b\n", "\r\n x\r", "▁a", "▁▁ a▁", "é\0x", "\0", "日本語 テスト", "<s>", "</s> <unk> <0x41>", " x", "﻿a", "🙂🙂 ok", "x" * 3000, " ".join("ab" * 500), "\t\ta"]


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def ids_of(b):
    return np.frombuffer(b, "<u4").tolist()


def test_equals_the_library(spark, plain):
    texts = ODD + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    p = pieces.pieces(pieces.default_model())
    for got, t in zip(p(texts), texts, strict=True):
        assert ids_of(got) == plain.encode(t), repr(t[:80])
        assert p.decode(p.begin + got + p.end) == plain.decode(plain.encode(t, add_bos=True, add_eos=True))
    assert [ids_of(x) for x in p(texts)] == [plain.encode(t) for t in texts]  # from the table


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\r\t▁abé日\0<>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    p = pieces.pieces(pieces.default_model())
    assert ids_of(p([text])[0]) == p.model.encode(text)


def test_memo_is_bounded_and_forgets(plain, monkeypatch):
    monkeypatch.setattr(C, "MEMO", 50)
    p = pieces.Pieces(pieces.default_model())
    texts = [f"word{i} other{i} " + "z" * 100 for i in range(200)]
    assert [ids_of(x) for t in texts for x in p([t])] == [plain.encode(t) for t in texts]
    assert len(p.young) <= 53 and len(p.old) <= 53 and not any(len(c) > C.MEMO_BYTES for c in [*p.young, *p.old])


def test_long_chunk_in_seconds(plain):
    word = "".join(np.random.default_rng(1).choice(list("etaoinshr"), 300_000))
    start = time.time()
    (got,) = pieces.pieces(pieces.default_model())([word])
    assert time.time() - start < 30 and plain.decode(ids_of(got)) == word


def test_digests_and_columns(spark, plain):
    rows = [(1, "été  x", 0), (2, None, 0), (2, None, 0), (None, "a", 0), (3, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m int")
    got = pieces.digests(docs).collect()
    ids = np.array(plain.encode("été  x", add_bos=True, add_eos=True), "<u4").tobytes()
    (r,) = [x for x in got if x.doc_id == 1]
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256("été  x".encode()).hexdigest())
    assert sorted(x.n_tokens for x in got if x.doc_id in (2, 3)) == [2, 2, 2] and len(got) == 5
    assert pieces.digests(docs.limit(0)).collect() == []
    back = pieces.decode(pieces.encode(docs), to="again").collect()
    assert [(r.text, r.again) for r in back] == [(t, t) for _, t, _ in rows]
    assert all(r.ids is None or r.ids[0] == 1 and r.ids[-1] == 2 for r in back)
