"""Connected components of chains and random graphs."""

import random

import pytest

from kartoteka.llm.components import components


@pytest.mark.parametrize("hops", [6, 4500])
def test_chain_of_ascending_ids_is_one_component(spark, hops):
    got = components(spark.range(hops).selectExpr("id as a", "id + 1 as b").coalesce(1)).collect()
    assert {x.node: x.component for x in got} == dict.fromkeys(range(hops + 1), 0)


def test_equals_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in got} == want
