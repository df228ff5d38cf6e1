"""Packing: exact ids, gapless offsets, and bins that the local search empties."""

import random
import zlib

import numpy as np
import pytest

from kartoteka.llm import packing

ODD = ["", "a", " a  b", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y  z", "été ÀÉ ñ", "日本語 テスト", "a\0b", "tab\there\n\n new", "I'm you'LL 1234567", "🙂 ok", "  ", " x y", "ɐ ɐ ʼn", "नमस्ते दुनिया", "٣٤٥ 12"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers(plain, spark):
    texts = ODD + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    fast = packing.tokenizer(packing.default_tokenizer(), packing.default_ranks())
    for got, t in zip(fast(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(t), t


def test_pieces_and_places(spark, plain):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(100, None, 1), (101, long, 1), (101, long, 1), (None, None, 1), (None, "a", 1), (None, "a", 1)]
    got = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string, _group int")).collect()
    by_bin, by_doc = {}, {}
    for r in got:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in enumerate(ODD):
        (r,) = by_doc[i]
        ids = np.array([*plain(t), 0], "<u4")
        assert (r.piece, r.start, r.length, r.ids_crc32) == (0, 0, len(ids), zlib.crc32(ids.tobytes()))
    n = len(plain(long)) + 1
    pieces = sorted((r.piece, r.start, r.length) for r in by_doc[101])[::2]
    assert pieces[0][2] == (n % 2048 or 2048) and all(p[2] == 2048 for p in pieces[1:]) and pieces[-1][1] + pieces[-1][2] == n
    assert len(by_doc[None]) == 3 and by_doc[100][0].length == 1
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_without_an_id_are_dealt_over_groups(spark):
    rows = spark.range(400).selectExpr("cast(null as long) as doc_id", "0 as piece", "700L as length", "'k' as sequence_id")
    got = packing.pack(rows, 2048, group=50)
    assert got.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    groups = {r.sequence_id >> 32 for r in got.collect()}
    assert len(groups) == 8


@pytest.mark.parametrize("seed", [1, 2])
def test_local_search_empties_bins(seed):
    """Pieces of 500 to 800 tokens: best fit leaves a bin in twenty too many, moves and exchanges empty most of these."""
    r = random.Random(seed)
    sizes = [r.randint(500, 800) for _ in range(600)]
    bins = packing.Bins(sizes, 2048)
    before, squares = len(bins.bins), sum((2048 - f) ** 2 for f in bins.free)
    bins.improve()
    assert sorted(i for b in bins.bins for i in b) == list(range(600))
    assert all(sum(sizes[i] for i in b) + f == 2048 and f >= 0 and b for b, f in zip(bins.bins, bins.free, strict=True))
    least = -(-sum(sizes) // 2048)
    assert len(bins.bins) < before and sum((2048 - f) ** 2 for f in bins.free) > squares
    assert len(bins.bins) - least <= 0.7 * (before - least)
