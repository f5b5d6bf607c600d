import numpy as np
import pytest

from __spark_entry__ import queries
from siftlake.llm import rankwalk
from siftlake.llm.rankwalk import best_scores, fuse, stationary, walk

NAN = float("nan")


def dense(scores, damping=0.85):
    """The chain written out as a matrix, and its eigenvector."""
    n, k = scores.shape
    s = np.where(np.isnan(scores), -np.inf, scores)
    p = np.zeros((n, n))
    for j in range(k):
        for i in range(n):
            higher = np.flatnonzero(s[:, j] > s[i, j])
            p[i, higher] += 1 / n / k
            p[i, i] += (1 - len(higher) / n) / k
    p = damping * p + (1 - damping) / n
    mass = np.full(n, 1 / n)
    for _ in range(2000):
        mass = mass @ p
    return mass


def cases():
    rng = np.random.default_rng(4)
    yield rng.normal(size=(30, 3)) * [1, 1000, 1e-6]
    yield np.where(rng.random((40, 3)) < 0.4, NAN, rng.integers(0, 5, (40, 3)).astype(float))
    yield np.full((7, 2), NAN)
    yield np.zeros((5, 3))
    yield np.array([[1.0, NAN, 2.0]])


def test_against_the_matrix():
    for scores in cases():
        assert stationary(scores) == pytest.approx(dense(scores), abs=1e-11)


def test_groups_walk_together_as_alone():
    parts = list(cases())
    scores = np.concatenate([p if p.shape[1] == 3 else np.column_stack([p, p[:, 0]]) for p in parts])
    groups = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    together = walk(groups, scores)
    for g in range(len(parts)):
        assert together[groups == g] == pytest.approx(walk(np.zeros((groups == g).sum(), int), scores[groups == g]), abs=1e-9)


def test_scale_does_not_matter():
    scores = np.random.default_rng(1).normal(size=(25, 3))
    assert stationary(scores) == pytest.approx(stationary(np.exp(scores * [1, 5, 0.1])), abs=1e-15)


def test_tasks_and_joins_give_the_same_places(spark, monkeypatch):
    monkeypatch.setattr(rankwalk, "ROUNDS", 8)  # as many rounds for both walks
    rng = np.random.default_rng(2)
    rows = [(g, i, None if rng.random() < 0.3 else float(rng.integers(0, 6)), float(rng.normal())) for g in ("a", "b") for i in range(12)] + [("c", 1, None, None), ("c", 2, None, NAN)]
    items = spark.createDataFrame(rows, "g string, i long, x double, y double")
    first, second = ({(r.g, r.i): r.place for r in fuse(items, "g", "i", ["x", "y"], in_task=n).collect()} for n in (100, 5))
    assert first == second and first["c", 1] == 1 and len(first) == 26
    assert fuse(items.limit(0), "g", "i", ["x", "y"]).count() == 0


def test_best_scores(spark):
    rows = [(1, "Lexical", 5, 1, -3.0), (1, "lexical ", 5, 2, -1.0), (1, "VECTOR", 5, 1, 0.5), (1, "vector", 5, 2, 0.7), (1, "vector", 6, 3, NAN), (1, "rerank", 6, None, None), (1, "other", 7, 1, 1.0), (None, "vector", 1, 1, 1.0), (1, "rerank", None, 1, 1.0), (1, None, 8, 1, 1.0), (1, "rerank", 9, 1, 2.0), (1, "rerank", 9, 1, 2.0)]
    got = [tuple(r) for r in best_scores(spark.createDataFrame(rows, "query_id long, branch string, doc_id long, chunk_id long, score double")).orderBy("doc_id").collect()]
    assert got == [(1, 5, 3.0, 0.7, None), (1, 9, None, None, 2.0)]


def test_query(spark, small):
    rows = queries()["p6_found"](spark, small).collect()
    assert len(rows) == len({tuple(r) for r in rows}) == 3 * len({r.query_id for r in rows})
