"""Quality verdicts: each distance alone rejects a document and spares a clean one."""

import random

import pytest

from kartoteka.llm import quality

EN, DE = "the of and to in is that for it was".split(), "der die und in den von zu das mit sich".split()


def prose(r, common, n=300, share=0.25):
    return " ".join(r.choice(common) if r.random() < share else "".join(r.choices("aeinrst", k=r.randint(4, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(4)
    rows = [(i, prose(r, (EN, DE)[i % 2]), ("en", "de")[i % 2]) for i in range(80)]
    rows += [(200 + i, prose(r, ["dom", "kot"], share=0.5) + (" the of and" if i % 4 == 0 else ""), "pl") for i in range(40)]
    rows += [
        (100, prose(r, EN, share=0), "en"),  # characters of the language, none of its words
        (101, prose(r, EN), "de"),  # words of another language
        (102, " ".join(w if w in EN else w + "###" for w in prose(r, EN).split()), "en"),  # its words among symbols
        (103, prose(r, EN), "en"),
        (104, prose(r, DE), "de"),
        (105, prose(r, EN, n=30, share=0), "en"),  # too short to judge
        (106, prose(r, EN), None),
    ]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    return {x.doc_id: x for x in got}


def test_each_distance_alone_rejects(judged):
    assert not any(judged[i].base_failed for i in range(100, 107))
    assert [judged[i].kept for i in range(100, 107)] == [False, False, False, True, True, True, True]
    assert judged[100].class_distance < quality.MAX_CLASS and judged[101].class_distance < quality.MAX_CLASS
    assert judged[102].class_distance > quality.MAX_CLASS and judged[102].common_distance < 0.2
    assert all(judged[i].kept for i in range(80))


def test_language_without_common_words_is_not_judged_by_them(judged):
    assert all(judged[200 + i].kept for i in range(40))


def test_distance_without_common_words(spark):
    table = quality.features(spark.createDataFrame([(1, "the cat sat", "en"), (2, "cat sat on", "en"), (3, "cat dog cow", "en")], "doc_id long, text string, lang string"), ("doc_id", "lang"))
    refs = quality.References(table, 1)
    got = {x.doc_id: x.common_distance for x in quality.distances(table, refs).collect()}
    assert got[3] == pytest.approx(refs.without("en"))


def test_counts_against_brute_force_and_clashing_names(spark):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    r = random.Random(8)
    texts = [None, "", " \n", "a # b & c\na # b & c\n\nx"] + [" ".join(r.choices("ab cd ef".split(), k=r.randint(1, 60))).replace("cd ef ab", "cd\nef") for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, "z", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, w string, n_words int")
    got = {x.doc_id: x for x in quality.judged(df, keep=("doc_id", "w", "lang", "n_words")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = word.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][f] for f in quality.FEATURES) == want
        assert got[i].base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and got[i].w == "z"
    assert quality.judged(df.limit(0)).collect() == []
