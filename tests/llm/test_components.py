from __future__ import annotations

import random

import pytest

from paperloom.llm.components import connected_groups, strong_links


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def groups(spark, edges, **k):
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a long, b long, u string")
    return {r.id: r.group_id for r in connected_groups(df, **k).collect()}


@pytest.mark.parametrize("share", [1e-3, 0.0])
def test_random_graph(spark, share):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (2, None), (7, 7)]
    assert groups(spark, edges, hub_share=share) == brute(edges)


def test_chain_star_and_repeats(spark):
    edges = [(i + 1, i) for i in range(70)] + [(500, 500 + i) for i in range(1, 90)] + [(1, 0)] * 3 + [(0, 1)]
    assert groups(spark, edges) == brute(edges)


def test_hubs_are_apart(spark):
    edges = [(0, i) for i in range(1, 2500)] + [(3000, 3001)]
    assert groups(spark, edges, hub_share=1e-4) == brute(edges)


def test_empty_and_scores(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(5, 5)]) == {}
    df = spark.createDataFrame([(1, 2, 0.92), (3, 4, 0.91), (5, 6, None), (7, 8, float("nan"))], "a long, b long, similarity double")
    assert [r.a for r in strong_links(df, 0.92).collect()] == [1]
