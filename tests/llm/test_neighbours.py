import numpy as np
import pytest

from __spark_entry__ import queries
from siftlake.llm.neighbours import distinct_vectors, fit_forest, neighbour_graph, ranked_neighbours, similar_pairs, usable_vectors, with_copies
from siftlake.plans.session import table


@pytest.fixture(scope="module")
def truth(spark):
    rows = usable_vectors(table(spark, "/root/testdata/sf0.01", "chunk_vectors")).collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.v for r in rows], "float64")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return ids, s, np.argsort(-s, axis=1, kind="stable")[:, :10]


def test_pairs_are_those_of_brute_force(spark, truth):
    ids, s, near = truth
    want = {tuple(sorted((int(ids[i]), int(ids[j])))) for i in range(len(ids)) for j in near[i] if s[i, j] >= 0.9}
    got = queries()["p5_found"](spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("chunk_a", "bigint"), ("chunk_b", "bigint")]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 50


@pytest.mark.parametrize("query", ["p5_neighbours", "p5_search"])
def test_recall(spark, truth, query):
    ids, s, near = truth
    got = {}
    for r in queries()[query](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r[0], set()).add(r[1])
    asked = [i for i in range(len(ids)) if query == "p5_neighbours" or ids[i] % 100 == 0]
    assert set(got) == {int(ids[i]) for i in asked} and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[int(ids[i])] & set(ids[near[i]].tolist())) / 10 for i in asked]) >= 0.9


def test_unusable_repeated_and_equal_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 64))
    rows = [(i, x[i].tolist()) for i in range(40)] + [(i, x[i % 3].tolist()) for i in range(100, 1100)]  # most rows share three vectors
    rows += [(0, x[0].tolist()), (2000, None), (2001, []), (2002, x[0][:32].tolist()), (2003, [0.0] * 64), (2004, [float("nan")] + [1.0] * 63), (2005, [float("inf")] + [1.0] * 63), (None, x[0].tolist()), (2006, [None] + [1.0] * 63), (2007, (x[5] * 1e-38).tolist()), (2008, (x[5] * 1e30).tolist())]
    vectors = usable_vectors(spark.createDataFrame(rows, "chunk_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS id", "3 AS q"))
    assert {r.id for r in vectors.select("id").collect()} == set(range(40)) | set(range(100, 1100)) | {2007, 2008}
    vectors = with_copies(vectors)
    graph = neighbour_graph(distinct_vectors(vectors), leaf=50, chunk=200)
    near = ranked_neighbours(vectors, graph, 10).collect()
    assert len(near) == 1042 * 10 and all(r.id != r.neighbour for r in near)
    assert all(r.score > 0.999999 for r in near if r.id >= 100 and r.id < 2000)
    pairs = {tuple(r) for r in similar_pairs(vectors, graph).collect()}
    assert (2007, 2008) in pairs and all(a < b for a, b in pairs)


def test_none_and_one(spark):
    for n in (0, 1, 2):
        vectors = with_copies(spark.createDataFrame([(i, [1.0, float(i)] + [0.5] * 62) for i in range(n)], "id long, v array<float>"))
        graph = neighbour_graph(distinct_vectors(vectors))
        assert graph.count() == n and similar_pairs(vectors, graph).count() == (n == 2)


def test_forest_puts_every_point_in_a_leaf():
    x = np.random.default_rng(0).normal(size=(500, 8)).astype("float32")
    forest = fit_forest(x, 3, 20)
    for t in range(3):
        leaves = forest.leaves(x, t)
        assert leaves.min() >= 0 and np.bincount(leaves).max() <= 40
    assert set(fit_forest(np.ones((9, 8), "float32"), 1, 2).leaves(np.ones((9, 8), "float32"), 0)) == {0}
