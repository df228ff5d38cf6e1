"""Licence scans against the SQL that looks for phrases in joined words."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import both, rows_of  # noqa: E402

from kartoteka.llm import licenses, queries
from kartoteka.llm.license_texts import BODIES  # noqa: E402


def test_equals_sql(spark):
    got, want = both(spark, queries.op3_license_scan, licenses.oracle(), "/root/testdata/sf0.01")
    assert got == want and len(got) == 1000


def test_places_labels_and_edges(spark):
    rows = [
        (1, "All Rights Reserved. CC-BY cc by; GENERAL public\nlicense", "x"),
        (2, None, "x"),
        (2, None, "x"),
        (3, "rights reserved all cc", "x"),
        (4, "Permission is hereby granted, free of charge ... THE SOFTWARE IS PROVIDED 'AS IS'", "x"),
        (None, "cc by sa " * 20_000, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    r = {x.doc_id: x for x in licenses.licenses_of_documents(df).collect()}
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == (10, 4, 0, 7, "cc-by,gpl,reserved")
    assert (r[2].n_words, r[2].n_base, r[2].first_word, r[2].labels, r[2].score) == (0, 0, None, "", 0.0)
    assert r[3].labels == "" and r[4].labels == "mit" and 0 < r[4].score <= 1
    assert r[None].n_base == 20_000 and r[None].labels == "cc-by,cc-by-sa"
    assert licenses.scan(df, keep=("found", "doc_id")).columns == ["doc_id", "n_words", "starts", "found"]
    assert licenses.licenses_of_documents(df.limit(0)).collect() == []


def edited(body: str, seed: int) -> str:
    """The body with about one word in twelve replaced, left out or doubled; never a word of its key phrases."""
    rng = random.Random(seed)
    words = body.split()
    fixed = {w for _, phrases, b in BODIES if b == body for p in phrases for w in p.split()}
    out = []
    for w in words:
        if rng.random() > 1 / 12 or set(licenses.split_words(w)) & fixed:
            out.append(w)
        else:
            out.extend(rng.choice(([], ["whatever"], [w, w])))
    return " ".join(out)


def test_edited_bodies_are_found_and_junk_is_not(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = sorted({w for _, _, b in BODIES for w in licenses.split_words(b)})
    texts = []
    for n, (_, _, body) in enumerate(BODIES):
        texts += [edited(body, n), "intro words " * (50 * n) + edited(body, 100 + n) + " and more " * 30]
    texts += [" ".join(rng.choices(vocabulary, k=3000)) for _ in range(5)]  # licence words in no order
    texts += ["software noninfringement as is " * 500, " ".join(b for _, _, b in BODIES), None, "", BODIES[0][2] + " x " + BODIES[0][2]]
    mit = BODIES[0][2]
    texts += [mit.replace("AS IS", "AS WAS"), " ".join(mit.split()[:40]), mit[len(mit) // 3 :] + " hereby granted"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = both(spark, queries.op3_license_scan, licenses.oracle(), str(tmp_path))
    assert got == want and len(got) == len(texts)
    labels = [r.labels.split(",") for r in licenses.licenses_of_documents(docs).sort("doc_id").collect()]
    for n, (label, *_) in enumerate(BODIES):
        assert label in labels[2 * n] and label in labels[2 * n + 1]
    n = 2 * len(BODIES)
    assert labels[n : n + 6] == [[""]] * 6
    assert set(labels[n + 6]) >= {label for label, *_ in BODIES}
    assert labels[n + 7 : n + 9] == [[""]] * 2 and "mit" in labels[n + 9]
    assert "mit" not in labels[n + 10] + labels[n + 11]  # a key phrase, half of the rare words is missing
    assert "mit" in labels[n + 12]  # a third of the body is missing, and a key phrase stands elsewhere in its reach


def test_body_without_an_intact_long_phrase(spark):
    """The words around the short key phrases are all changed now and then, and the body is found about where it stands."""
    text = (
        "one two three Permission now is hereby granted, at no charge, to each person obtaining a copy of this software and its associated "
        "documentation (the Software), to deal in the Software without any restriction, including without limitation rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and sell copies of the Software, and to permit persons to whom it is furnished to "
        "do so, subject to these conditions: The above copyright notice and this permission notice must be included in all copies or "
        "substantial portions of the Software. The software comes as is, with no warranty of any sort, express or implied, including the "
        "warranties of merchantability, fitness for some purpose and noninfringement. In no event shall its holders be liable for a claim, "
        "damages or other liability, in an action of contract, tort or otherwise, arising from or in connection with the software."
    )
    (r,) = licenses.scan(spark.createDataFrame([(text,)], "text string")).collect()
    assert [x.label for x in r.found] == ["mit"] and 0 <= r.found[0].place <= 12


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
