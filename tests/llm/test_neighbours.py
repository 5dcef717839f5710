from __future__ import annotations

import numpy as np
import pytest

from paperloom.llm.neighbours import VectorTree, nearest_neighbours, neighbour_pairs


def table(spark, vectors, ids=None):
    ids = ids or range(len(vectors))
    return spark.createDataFrame([(int(i), [float(x) for x in v] if v is not None else None, 1) for i, v in zip(ids, vectors, strict=True)], "id long, embedding array<float>, cell int")


def brute(v, k):
    m = np.array(v, np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(m)), -s[i]))[:k]] for i in range(len(m))}


def found(df, **k):
    out = {}
    for r in nearest_neighbours(df, **k).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((60, 16))
    v = np.repeat(centre, 8, 0) + 0.15 * rng.standard_normal((480, 16))
    got, want = found(table(spark, v), dim=16, leaf_rows=16), brute(v, 5)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.95


def test_one_leaf_is_exact_in_blocks(spark):
    v = np.random.default_rng(2).standard_normal((60, 8))
    assert found(table(spark, v), dim=8, leaf_rows=1000, block_rows=7, query_rows=11) == brute(v, 5)


def test_copies_and_ties(spark):
    v = [[1, 0]] * 9 + [[1, 0.1]] + [[0, 1]] * 2
    got = found(table(spark, v), dim=2, k=3)
    assert got[0] == [1, 2, 3] and got[8] == [0, 1, 2] and got[9] == [0, 1, 2]
    assert got[10][0] == 11 and got[11][0] == 10 and len(got[10]) == 3


def test_unusable_rows(spark):
    v = [None, [0, 0], [1], [float("nan"), 1], [1, 1], [2, 2.1], []]
    assert found(table(spark, v), dim=2) == {4: [5], 5: [4]}
    assert found(table(spark, []), dim=2) == {}
    assert found(table(spark, [[1, 2]]), dim=2) == {}


def test_repeated_rows_and_pairs(spark):
    v = [[1, 0], [1, 0.2], [0, 1]]
    df = table(spark, v)
    pairs = {tuple(r) for r in neighbour_pairs(nearest_neighbours(df.unionByName(df), dim=2, k=1)).collect()}
    assert pairs == {(0, 1), (1, 2)}


@pytest.mark.parametrize("leaves", [1, 5, 40])
def test_tree_visits_distinct_leaves(leaves):
    x = np.random.default_rng(3).standard_normal((200, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = VectorTree.fit(x, leaves, fanout=4)
    seen = t.visit(x[:10], t.n_leaves)
    assert all(sorted(r) == list(range(t.n_leaves)) for r in seen)
