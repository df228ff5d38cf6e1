"""Byte-level BPE against tiktoken, and round trips."""

import base64
import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kartoteka.llm import bpe

ODD = ["", "a", " a  b ", "été ÀÉ", "日本語 テスト", "a\0b", "\n\n new\r\n line", "I'm you'LL 1234567", "🙂🙂", "<|endoftext|>", " x y", "z" * 1500, "ab" * 3000, "日本" * 900]


@pytest.fixture(scope="module")
def plain():
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken(spark, plain):
    texts = ODD + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    e = bpe.encoder(bpe.default_ranks(), public_tokenizers.PATTERN)
    for got, t in zip(e.texts(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode_ordinary(t)
        assert e.decode(got) == t.encode()


def test_long_piece_in_seconds(plain):
    e = bpe.encoder(bpe.default_ranks(), public_tokenizers.PATTERN)
    word = "".join(np.random.default_rng(1).choice(list("etaoinshr"), 300_000))
    start = time.time()
    (got,) = e.pieces([word.encode()])
    assert time.time() - start < 30 and e.decode(got) == word.encode()
    short = word[:5000].encode()
    assert np.frombuffer(e.pieces([short])[0], "<u4").tolist() == plain.encode_ordinary(word[:5000])


def test_digests(spark, plain):
    rows = [(1, "été x", 0), (2, None, 0), (2, None, 0), (None, "a", 0)]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, m int")).collect()
    ids = np.array(plain.encode_ordinary("été x"), "<u4").tobytes()
    (r,) = [x for x in got if x.doc_id == 1]
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256("été x".encode()).hexdigest())
    assert [x.n_tokens for x in got if x.doc_id == 2] == [0, 0] and len(got) == 4
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
