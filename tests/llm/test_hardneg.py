"""Hard negatives against SQL and against brute force on hard cases."""

import math

import numpy as np
import pytest
from compare import both

from kartoteka.llm import hardneg, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        q = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        known[i] = min(known.get(i, q), q)
    out = []
    for a in sorted(i for i in known if i % 50 == 0):
        scores = sorted((-sum(x * y for x, y in zip(known[a][1], known[i][1], strict=False)), i) for i in known if i != a)
        for s, p in [(-s, i) for s, i in scores if known[i][0] == known[a][0]][:5]:
            near = [(-t, i) for t, i in scores if known[i][0] != known[a][0] and 50 * s <= -100 * t <= 95 * s][:3]
            out += [(a, p, k + 1, i, s, t) for k, (t, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    got, want = both(spark, queries.QUERIES["op11_hard_negatives"], queries.ORACLE["op11_hard_negatives"], f"/root/testdata/{sf}")
    assert got == want and got


def made(seed, n, copies, scale=1.0, dim=6):
    g = np.random.default_rng(seed)
    v = (g.normal(size=(n, dim)) * scale).astype(np.float32)
    v[:copies] = v[0]
    v[copies : 2 * copies] = v[0] * np.float32(0.7)  # within the window of the copies
    return [(i * 5 - 40, x.tolist(), int(g.integers(0, 3))) for i, x in enumerate(v)]


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (3, 2e5)])
def test_ties_go_on_through_ids(spark, monkeypatch, seed, scale):
    """A third of all rows is one vector: digits run out of scores and go on in ids; small digits, groups and gathers."""
    monkeypatch.setattr(hardneg, "GATHER", 5)
    monkeypatch.setattr(hardneg, "DIGIT_BITS", 3)
    monkeypatch.setattr(hardneg, "GROUP", 9)
    rows = made(seed, 180, 60, scale)
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows) and got


def test_what_takes_no_part(spark):
    rows = made(4, 60, 10)
    bad = [(1000, None, 1), (1050, [1.0] * 6, None), (1100, [1.0, None] * 3, 1), (1150, [float("nan")] * 6, 1), (1200, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1)]
    odd = [(1250, [], 1), (1300, [1.0, 2.0], 1), (1300, [1.0, 2.0], 1), (1300, [0.5, 9.0], 0)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows + bad + odd], SCHEMA + ", rank int, w string")
    got = sorted(tuple(r) for r in hardneg.hard_negatives(df).collect())
    assert got == brute(rows + bad + odd) and got
    assert hardneg.hard_negatives(df.limit(0)).collect() == []
    assert hardneg.hard_negatives(df.where("vec_id % 50 > 0")).collect() == []


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(ValueError, match="long"):
        hardneg.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], SCHEMA))
