"""Product codes against a plain k-means, neighbours against brute force, and odd rows of both."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from docketry.llm import equalaverage, queries, smallworld
from docketry.llm.tables import table

ODD = "vec_id long, embedding array<double>, label int, code string, score double"


def rows(spark, vectors, ids=None, labels=None):
    ids = list(range(len(vectors))) if ids is None else ids
    labels = [None] * len(vectors) if labels is None else labels
    return spark.createDataFrame([(i, v, x, "clash", 0.5) for i, v, x in zip(ids, vectors, labels, strict=True)], ODD)


def plain_codes(ids, vectors, labels):
    """The contract, word by word, with full distance tables."""
    order = np.argsort(ids, kind="stable")
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64)
    parts = x.reshape(len(x), 4, -1)
    books = parts[order[:256]].transpose(1, 0, 2).copy()

    def assigned():
        found = [((parts[:, p, None, :] - books[p][None]) ** 2).sum(-1) for p in range(4)]
        return [d.argmin(1) for d in found], [d.min(1) for d in found]

    for _ in range(4):
        at, _ = assigned()
        for p in range(4):
            for k in np.unique(at[p]):
                mine = parts[at[p] == k, p]
                books[p, k] = mine.sum(0) // len(mine)
    at, distance = assigned()
    error = sum(distance)
    total = {}
    for label, e in zip(labels, error, strict=True):
        total[label] = total.get(label, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return {i: ("".join(f"{at[p][j]:02x}" for p in range(4)), int(error[j]), total[labels[j]], sha) for j, i in enumerate(ids)}


def coded(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in equalaverage.compressed(df).collect()}


def test_codes_match_a_plain_version(spark, small):
    kept = table(spark, small, "embeddings").collect()
    want = plain_codes([r.vec_id for r in kept], [r.embedding for r in kept], [r.label for r in kept])
    found = queries.op11_equalaverage(spark, small).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in found} == want


def test_codes_of_few_rows_with_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.integers(-2, 3, (300, 8)) / 1024).tolist()  # small integers: many equal distances and equal entries
    ids, labels = rng.permutation(300).tolist(), [None if i % 3 == 0 else i % 4 for i in range(300)]
    assert coded(rows(spark, vectors, ids, labels)) == plain_codes(ids, vectors, labels)
    few = [[0.5] * 4, [0.5] * 4, [-0.25, 0.0, 1.0, 2.0]]
    assert coded(rows(spark, few, [7, 3, 5])) == plain_codes([7, 3, 5], few, [None] * 3)


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(2)
    for spread in (3, 60, 4000):
        entries, x = rng.integers(-spread, spread, (200, 5)), rng.integers(-spread, spread, (700, 5))
        found, distance = equalaverage.Codebook(entries).nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(-1)
        assert (distance == every.min(1)).all() and (found == every.argmin(1)).all()


def test_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    df = rows(spark, [None, [1.0, None, 0.0, 0.0], [nan, 0.0, 0.0, 0.0], [0.0, -inf, 0.0, 0.0], [], [1.0], [0.001] * 6, [1e300, -1e300, 0.0, 0.0]], [1, 2, 3, 4, 5, 6, None, 8])
    found = coded(df)
    assert set(found) == {5, 6, None, 8} and found[5][1] == 0 and all(len(f[0]) == 8 for f in found.values())
    assert equalaverage.compressed(df.limit(0)).count() == 0
    assert coded(df.unionByName(df.where("vec_id = 6")))[6][0] == found[6][0]


def plain_neighbours(kept, k=5, every=50):
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept], float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for at in np.flatnonzero(ids % every == 0):
        score = x @ x[at]
        score[at] = -np.inf
        order = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        found[int(ids[at])] = [(int(ids[j]), score[j]) for j in order]
    return found


def near(df):
    found = {}
    for r in smallworld.neighbours(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_neighbours_against_brute_force(spark, small):
    kept = [(r.vec_id, r.embedding) for r in table(spark, small, "embeddings").collect()]
    want, found = plain_neighbours(kept), near(table(spark, small, "embeddings"))
    assert set(found) == set(want) and all(len(f) == 5 for f in found.values())
    hits = [v in dict(want[q]) for q, f in found.items() for v, _ in f]
    assert np.mean(hits) >= 0.98
    assert all(math.isclose(s, dict(want[q])[v], abs_tol=1e-12) for q, f in found.items() for v, s in f if v in dict(want[q]))


def test_recall_of_shards_and_of_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2_400, 24))
    x[:800] = x[0] + rng.normal(size=(800, 24)) * 1e-3  # a third lies close together
    kept = list(zip(rng.permutation(2_400).tolist(), x.tolist(), strict=True))
    want = plain_neighbours(kept)
    found = near(rows(spark, [v for _, v in kept], [i for i, _ in kept]))
    hits = [s >= want[q][-1][1] - 1e-12 for q, f in found.items() for _, s in f]
    assert set(found) == set(want) and np.mean(hits) >= 0.95


def test_equal_vectors_come_by_id(spark):
    vectors = [[1.0, 2.0, 0.5]] * 40 + [[2.0, 4.0, 1.1], [-1.0, 0.0, 0.0]]
    found = near(rows(spark, vectors, list(range(100, 142))))
    assert [v for v, _ in found[100]] == [101, 102, 103, 104, 105]
    assert near(rows(spark, vectors[:20], list(range(50, 70))))[50][0] == (51, found[100][0][1])


def test_neighbours_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    df = rows(spark, [None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [], [1.0, 1.0], [1.0, 0.9], [1e200, 1e200], [3.0, 4.0, 5.0]], [0, 50, 100, 150, 200, 250, 300, 7, None, 350])
    found = near(df)
    assert {q: [v for v, _ in f] for q, f in found.items()} == {300: [7]}  # 350 has nobody of its length
    assert smallworld.neighbours(df.limit(0)).count() == 0
    twice = near(rows(spark, [[1.0, 1.0], [1.0, 1.0], [1.0, 0.5], [1.0, 0.5]], [50, 50, 3, 3]))
    assert [v for v, _ in twice[50]] == [3]


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_a_graph_finds_itself(n):
    x = np.random.default_rng(n).normal(size=(n, 12))
    graph = smallworld.Graph.built(np.arange(n), x)
    score, found = graph.nearest(x, 1)
    assert np.mean(found[:, 0] == np.arange(n)) > 0.99 and np.allclose(score[found[:, 0] == np.arange(n)], 1)
