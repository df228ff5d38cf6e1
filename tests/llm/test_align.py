"""Alignment by byte-owner arrays against plain loops over bytes."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kartoteka.llm import _common as C
from kartoteka.llm import align, packing, pieces, queries

ODD = [None, "", "a", "a ", " a", "a  b", "a\nb c", "a\r\nb", "▁a", "x ▁ y", "é\0x", "日本語 テスト\nв доме", "<|endoftext|> <s>", "🙂🙂 ok\tno", "internationalisation of unbelievable tokenizers", "z" * 700, "\n", "a\n", " "]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(packing.default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def ends_of(tokens):
    return np.cumsum([len(t) for t in tokens]).tolist()


def brute(texts, plain):
    a, b = plain
    byte_of = align._byte_of()
    docs = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids
        y = b.encode(t or "")
        left = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in x]
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        groups = []
        if t and b"".join(left) == whole == b"".join(right):
            ea, eb = ends_of(left), ends_of(right)
            at, i, j = 0, 0, 0
            for cut in sorted(set(ea) & set(eb)):
                k, m = ea.index(cut) + 1, eb.index(cut) + 1
                groups.append((x[i:k], y[j:m]))
                i, j = k, m
        docs.append(groups)
    count = Counter(p for groups in docs for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sums = (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links))
        out.append((*sums, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def test_equals_plain_loops(spark, plain):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(150).collect()]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in align.alignment_of_documents(docs).collect()}
    want = brute(texts, plain)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, repr(texts[i])[:200]
    assert sum(w[0] == 0 for w in want) == 4  # null, empty, and two with the marker's own character


def test_chunks_and_parts_change_nothing(plain, monkeypatch):
    """Small parts of links, small memos, documents over several chunks."""
    texts = ["one two three", "unbelievable two\nthree", "one one one", "z" * 300, "", "a  b"]
    p = align.Pair(packing.default_tokenizer(), None, pieces.default_model())
    whole = align._chunk([*range(6)], texts, p).iloc[0]
    monkeypatch.setattr(align, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(align, "JOINED", 5)
    monkeypatch.setattr(C, "MEMO", 2)
    small = align._chunk([*range(6)], texts, align.Pair(packing.default_tokenizer(), packing.default_ranks(), pieces.default_model())).iloc[0]
    for c in ("ids", "sums", "hashes", "sizes", "codes", "times"):
        assert whole[c] == small[c], c
    assert whole["pairs"].tolist() == small["pairs"].tolist() and whole["held"].tolist() == small["held"].tolist()


def test_repeats_nulls_and_empty_tables(spark, plain):
    rows = [(1, "same text", 0), (1, "same text", 0), (None, "same text", 0), (2, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int")
    got = sorted((tuple(r) for r in align.alignment_of_documents(docs).collect()), key=str)
    want = brute([t for _, t, _ in rows], plain)
    assert got == sorted(((i, *w) for (i, _, _), w in zip(rows, want, strict=True)), key=str)
    assert align.alignment_of_documents(docs.limit(0)).collect() == []


def test_align_column(spark, plain):
    got = align.align(spark.createDataFrame([("unbelievable  tests",), (None,), ("",), ("▁",)], "text string")).collect()
    r = got[0].alignment
    a, b = plain
    assert r.a_ids == a.encode(" unbelievable  tests", add_special_tokens=False).ids and r.b_ids == b.encode("unbelievable  tests")
    assert r.a_groups[-1] == r.b_groups[-1] and len(r.overlap_a) == len(r.overlap_b) >= max(len(r.a_ids), len(r.b_ids))
    assert set(zip(r.overlap_a, r.overlap_b, strict=True)) <= {(i, j) for i, g in enumerate(r.a_groups) for j, h in enumerate(r.b_groups) if g == h}
    assert got[1].alignment is None and got[2].alignment.a_ids == [] and got[3].alignment.b_ids == []


def test_registered():
    assert "op12_token_alignment" in queries.QUERIES
