"""The stages, one by one on what they have to decide, and the whole run."""

import zlib

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _toxicity int, _near int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2) for i, t in rows], SCHEMA)


def test_near_duplicates_keep_the_least_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text), (3, text), (9, text + " more"), (7, "another text of a few more words"), (None, text), (None, None), (11, None)]
    docs = frame(spark, rows)
    got = P.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [11, 3, 7, None, None]


def test_toxicity_keeps_texts_without_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = frame(spark, [(10**9, None), (10**9 + 1, "")]).select(docs.columns)
    got = P.toxicity_stage(spark, docs.unionByName(more), SF)
    left = {r.doc_id for r in got.select("doc_id").collect()}
    assert {10**9, 10**9 + 1} <= left and got.columns == docs.columns
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learned = [i for i in marks if zlib.crc32(str(i).encode()) % 5]
    assert not [i for i in learned if marks[i] == 1 and i in left] and sum(i in left for i in learned if marks[i] == 0) >= 0.97 * sum(marks[i] == 0 for i in learned)


def test_run_packs_what_the_stages_keep(spark):
    got = P.run(spark, SF).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of_one in places.values():
        at = 0
        for offset, length in sorted(of_one):
            assert offset == at
            at += length
        assert at <= 2048
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0.5 * docs.count() < len({r.doc_id for r in got}) < docs.count()
