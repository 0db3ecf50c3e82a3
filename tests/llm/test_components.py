"""Connected components on graphs whose labels take many hops."""

import random

import pytest

from lattiq.llm import near_dedup


def brute(edges):
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def chain(n, seed):
    ids = list(range(n))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:]))


def mixed(seed):
    r = random.Random(seed)
    hub = [(500, i) for i in range(1000, 1200)]
    loose = [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)]
    return [e for e in hub + loose if e[0] != e[1]]


@pytest.mark.parametrize("edges", [chain(600, 1), [(i, i + 1) for i in range(300)], mixed(3)], ids=["shuffled", "ordered", "mixed"])
def test_components(spark, edges):
    got = {r["doc_id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_components_without_edges(spark):
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []
