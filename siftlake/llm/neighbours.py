"""Most similar vectors for every vector: a neighbour graph by NN-descent, and greedy search on it.

The graph starts from a forest of random hyperplane trees (exact neighbours within each leaf) and is then improved in rounds:
every vertex joins the neighbours that point to it and from it, for a neighbour of a neighbour is likely a neighbour. A round
is two Spark joins and one top-k per vertex; only pairs with a member that is new since the last round are looked at, and
only those that improve a list leave their task. Vectors travel as 64 signed bytes; scores that count are computed again in
double precision from the vectors as given. The forest is fitted on a bounded sample, every vector is indexed.
"""

from __future__ import annotations


from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.plans.session import cut

DIMENSIONS = 64
#: Vectors the driver fits the forest on, trees, vectors in a leaf, rows of a leaf in one task, and neighbours kept while descending.
SAMPLE, TREES, LEAF, CHUNK, WIDTH = 20_000, 6, 500, 4_000, 12
#: Neighbours of a vertex joined at once (a hub is joined in several lots), rounds at most, vertices in one task's group.
LOT, ROUNDS, BUCKET = 64, 4, 2_000
#: Rounds end when fewer than this share of the kept neighbours is new.
SETTLED = 0.01


def usable_vectors(chunks: DataFrame, key: str = "chunk_id", vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, v): one vector of `dimensions` finite numbers, not all zero, per id. Of several vectors of an id the largest counts."""
    v = F.col(vector).cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = chunks.filter(F.col(key).isNotNull() & (F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0))
    return good.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(v).alias("v"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of unit length from a list column without nulls."""
    x = np.asarray(column.flatten(), "float64").reshape(-1, dimensions)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")


def _bytes_of(x: np.ndarray) -> pa.Array:
    """Unit vectors as signed bytes, scaled to their largest component."""
    q = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype("int8")
    width = q.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(np.arange(0, (len(q) + 1) * width, width, dtype="int32")), pa.py_buffer(np.ascontiguousarray(q))])


def _from_bytes(column: pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = np.frombuffer(b"".join(column.to_pylist()), "int8").reshape(-1, dimensions).astype("float32")
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)


@dataclass
class Forest:
    """Trees as arrays: plane and offset of each inner node, and its two children; a child below 0 is leaf -child - 1."""

    planes: list[np.ndarray]
    offsets: list[np.ndarray]
    children: list[np.ndarray]

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(x), "int64")
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.planes[tree][node]) >= self.offsets[tree][node]
            at[inner] = self.children[tree][node, side.astype(int)]
        return -at - 1


def fit_forest(x: np.ndarray, trees: int, leaf: int, seed: int = 7) -> Forest:
    """Trees over a sample; each inner node halves its points by the plane between two of them."""
    rng = np.random.default_rng(seed)
    forest = Forest([], [], [])
    for _ in range(trees):
        planes, offsets, children, leaves = [], [], [], 0
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            members, parent, side = todo.pop()
            plane = None
            if len(members) > leaf:
                a, b = rng.choice(members, 2, replace=False)
                plane = x[a] - x[b]
                along = x[members] @ plane
                offset = np.median(along)
                upper = along >= offset
                if not upper.any() or upper.all():
                    plane = None  # all alike
            if plane is None and planes:
                leaves += 1
                children[parent][side] = -leaves
                continue
            if plane is None:  # a single leaf
                plane, offset, upper = np.zeros(x.shape[1], "float32"), 0.0, np.ones(len(members), bool)
                planes.append(plane), offsets.append(offset), children.append([-1, -1])
                continue
            planes.append(plane), offsets.append(offset), children.append([0, 0])
            here = len(planes) - 1
            if parent >= 0:
                children[parent][side] = here
            todo += [(members[~upper], here, 0), (members[upper], here, 1)]
        forest.planes.append(np.array(planes, "float32"))
        forest.offsets.append(np.array(offsets, "float32"))
        forest.children.append(np.array(children, "int64"))
    return forest


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, width: int, fresh: np.ndarray | None = None) -> np.ndarray:
    """Positions of the `width` best distinct b of each a, ordered by a and falling s; of equal pairs one that is not fresh stays."""
    order = np.lexsort((s, b, a) if fresh is None else (fresh, b, a))
    first = np.ones(len(a), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    order = order[first]
    order = order[np.lexsort((b[order], -s[order], a[order]))]
    start = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < width]


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float32())])


def _pairs(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], schema=_PAIRS)


def _within(ids: np.ndarray, x: np.ndarray, width: int, leaf: int, rng) -> list[tuple]:
    """The `width` nearest of each row among its own leaf; groups above `leaf` rows are halved by random planes."""
    out, todo = [], [np.arange(len(ids))]
    while todo:
        m = todo.pop()
        if len(m) > leaf:
            i, j = rng.choice(m, 2, replace=False)
            along = x[m] @ (x[i] - x[j])
            half = np.argsort(along, kind="stable")
            todo += [m[half[: len(m) // 2]], m[half[len(m) // 2 :]]]
            continue
        if len(m) < 2:
            continue
        s = x[m] @ x[m].T
        np.fill_diagonal(s, -2)
        k = min(width, len(m) - 1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out.append((np.repeat(ids[m], k), ids[m][near].ravel(), np.take_along_axis(s, near, 1).ravel()))
    return out


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("bucket")


_STATE = "id long, q binary, near array<long>, score array<float>, fresh array<boolean>"


def _merged(vectors: DataFrame, old: DataFrame | None, candidates: DataFrame, width: int, buckets: int, dimensions: int) -> DataFrame:
    """The state after taking in candidates: per vertex its `width` best neighbours, those that come new marked fresh."""
    none = lambda kind: F.lit(None).cast(kind)
    parts = vectors.select("id", "q", none("long").alias("b"), none("float").alias("s"), F.lit(False).alias("fresh"))
    if old is not None:
        kept = old.select("id", F.explode(F.arrays_zip("near", "score")).alias("e")).select("id", none("binary").alias("q"), F.col("e.near").alias("b"), F.col("e.score").alias("s"), F.lit(False).alias("fresh"))
        parts = parts.unionByName(kept)
    parts = parts.unionByName(candidates.select(F.col("a").alias("id"), none("binary").alias("q"), "b", "s", F.lit(True).alias("fresh")))

    def top(t: pa.Table) -> pa.Table:
        b = t.column("b")
        edges, own = t.filter(b.is_valid()), t.filter(b.is_null())
        a, to, s, new = (edges.column(c).to_numpy() for c in ("id", "b", "s", "fresh"))
        at = _best(a, to, s, width, new)
        ids = own.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        known = np.isin(a[at], ids)
        at = at[known]
        ends = np.append(np.searchsorted(a[at], ids, "left"), len(at)).astype("int32")
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
        return pa.table([pa.array(ids), own.column("q").take(pa.array(order)).combine_chunks().cast(pa.binary()), lists(to[at], pa.int64()), lists(s[at], pa.float32()), lists(new[at], pa.bool_())], ["id", "q", "near", "score", "fresh"])

    return parts.select(_bucket("id", buckets), "*").groupBy("bucket").applyInArrow(lambda t: top(t), _STATE)


def neighbour_graph(vectors: DataFrame, width: int = WIDTH, trees: int = TREES, rounds: int = ROUNDS, sample: int = SAMPLE, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """(id, q, near, score, fresh): the `width` nearest vertices of each of `vectors` (id, v), best first, by NN-descent.

    Scores are cosines of the vectors rounded to bytes (off by about 0.002). A single vector has an empty list.
    """
    spark = vectors.sparkSession
    dimensions = DIMENSIONS

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _bytes_of(_matrix(b.column(1), dimensions))], ["id", "q"])

    small = cut(vectors.mapInArrow(packed, "id long, q binary"))
    n = small.count()
    buckets = max(1, -(-n // BUCKET))
    some = small.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(some):
        return small.select("id", "q", F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("score"), F.array().cast("array<boolean>").alias("fresh"))
    forest = spark.sparkContext.broadcast(vars(fit_forest(_from_bytes(pa.array(some["q"]), dimensions), trees, max(4, leaf * len(some) // n))))  # plain arrays, so that executors need no copy of this package

    def placed(batches):
        fitted = Forest(**forest.value)
        for b in batches:
            x = _from_bytes(b.column(1), dimensions)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, "int32")), pa.array(fitted.leaves(x, t).astype("int32")), b.column(0), b.column(1)], ["tree", "leaf", "id", "q"])

    where = small.mapInArrow(placed, "tree int, leaf int, id long, q binary")
    # a leaf may hold any share of all rows (equal vectors): its rows are dealt to lots of at most `chunk`
    sizes = F.broadcast(where.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("lots")))  # as many rows as leaves of the forest: bounded by the sample
    lots = where.join(sizes, ["tree", "leaf"]).withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")))

    def start(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), _from_bytes(t.column("q"), dimensions)
        found = _within(ids, x, width, leaf, np.random.default_rng(len(ids)))
        return _pairs(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else _PAIRS.empty_table()

    first = lots.groupBy("tree", "leaf", "lot").applyInArrow(lambda t: start(t), "a long, b long, s float")
    state = cut(_merged(small, None, first, width, buckets, dimensions))
    for _ in range(rounds):
        fresh = state.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if fresh <= SETTLED * n * width:
            break
        state = cut(_merged(small, state, _joined(state, width, buckets, dimensions), width, buckets, dimensions))
        spark._jvm.System.gc()  # lets the driver free the shuffle files of the round before
    return state


def _joined(state: DataFrame, width: int, buckets: int, dimensions: int) -> DataFrame:
    """(a, b, s): pairs of vertices that a common neighbour joins and that improve the list of a."""
    worst = F.when(F.size("near") >= width, F.element_at("score", -1)).otherwise(-2.0).cast("float")
    nodes = state.select("id", "q", worst.alias("bar"))
    edges = state.select("id", "q", worst.alias("bar"), F.explode(F.arrays_zip("near", "fresh")).alias("e")).select("id", "q", "bar", F.col("e.near").alias("to"), F.col("e.fresh").alias("fresh"))
    inward = edges.select(F.col("to").alias("centre"), "id", "q", "bar", "fresh")
    outward = edges.select(F.col("id").alias("centre"), F.col("to").alias("id"), "fresh").join(nodes, "id").select("centre", "id", "q", "bar", "fresh")

    def local(t: pa.Table) -> pa.Table:
        centre, ids, bar, fresh = (t.column(c).to_numpy() for c in ("centre", "id", "bar", "fresh"))
        order = np.lexsort((~fresh, ids, centre))
        keep = np.ones(len(order), bool)  # a mutual neighbour counts once
        keep[1:] = (centre[order][1:] != centre[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        order = order[keep]
        x = _from_bytes(t.column("q"), dimensions)[order]
        centre, ids, bar, fresh = centre[order], ids[order], bar[order], fresh[order]
        edges = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
        out = []
        for lo, hi in zip(edges.tolist(), np.append(edges[1:], len(ids)).tolist(), strict=True):
            for at in range(lo, hi, LOT):
                end = min(at + LOT, hi)
                new = fresh[at:end]
                if end - at < 2 or not new.any():
                    continue
                s = x[at:end] @ x[at:end].T
                better = (new[:, None] | new) & (s > bar[at:end, None])
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                if len(i):
                    out.append((ids[at + i], ids[at + j], s[i, j]))
        if not out:
            return _PAIRS.empty_table()
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        at = _best(a, b, s, width)
        return _pairs(a[at], b[at], s[at])

    both = inward.unionByName(outward).select(_bucket("centre", buckets), "*")
    return both.groupBy("bucket").applyInArrow(lambda t: local(t), "a long, b long, s float")


def with_cosine(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of `rows` (which has the vectors _va and _vb) and their cosine in double precision as `score`.

    Vectors are scaled by their largest component first, so that no square overflows.
    """
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            x, y = (np.asarray(b.column(len(keep) + i).flatten(), "float64").reshape(b.num_rows, -1) for i in (0, 1))
            x, y = (v / np.abs(v).max(1, keepdims=True, initial=1e-300) for v in (x, y))
            score = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(score)], [*keep, "score"])

    return rows.select(*keep, "_va", "_vb").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "score double"]))


def exact_scores(pairs: DataFrame, vectors: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(left, right, score) of `pairs`, the cosine of the vectors of their two ids as they are given."""
    v = lambda side, name: vectors.select(F.col("id").alias(side), F.col("v").alias(name))
    return with_cosine(pairs.select(left, right).join(v(left, "_va"), left).join(v(right, "_vb"), right), [left, right])


def with_copies(vectors: DataFrame) -> DataFrame:
    """`vectors` (id, v) with `rep`, the least id that has exactly this vector; the graph is built on such ids alone."""
    return vectors.join(vectors.groupBy("v").agg(F.min("id").alias("rep")), "v").select("id", "v", "rep")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Of `vectors` (id, v, rep) one of each group of copies."""
    return vectors.filter("id = rep").select("id", "v")


def ranked_neighbours(vectors: DataFrame, graph: DataFrame, k: int, at_least: float = -1.0) -> DataFrame:
    """(id, neighbour, score, rank) for all of `vectors` (id, v, rep): the best k, with exact scores, from `at_least` on.

    `graph` holds the distinct vectors. A neighbour stands for its copies, of which the k + 1 least ids are enough; equal
    scores are ordered by id.
    """
    edges = graph.select("id", F.explode(F.arrays_zip("near", "score")).alias("e")).filter(F.col("e.score") >= at_least - 0.02).select("id", F.col("e.near").alias("other"))
    scored = exact_scores(edges, distinct_vectors(vectors), "id", "other").filter(F.col("score") >= at_least)
    least = vectors.select("rep", "id").withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1)
    copies = least.select(F.col("rep").alias("other"), F.col("id").alias("neighbour"))
    own = least.select("rep", F.col("id").alias("neighbour"), F.lit(1.0).alias("score"))
    all_ = scored.join(copies, "other").select(F.col("id").alias("rep"), "neighbour", "score").unionByName(own)
    top = all_.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "neighbour"))).filter(F.col("n") <= k + 1)
    each = vectors.select("id", "rep").join(top.select("rep", "neighbour", "score"), "rep").filter("id <> neighbour")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "neighbour", "score", "rank")


def similar_pairs(vectors: DataFrame, graph: DataFrame, k: int = 10, at_least: float = 0.9) -> DataFrame:
    """(chunk_a, chunk_b), a < b: one is among the other's k most similar, and their cosine is `at_least`."""
    near = ranked_neighbours(vectors, graph, k, at_least)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def greedy_search(vectors: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, beam: int = 24, rounds: int = 8, entries: int = 256) -> DataFrame:
    """(query, id, score, rank): the k most similar vectors of each of `queries` (query, v), found by walking the graph.

    A query starts from its best of `entries` vertices taken by hash (a fixed number, compared by broadcast), and each round
    looks at the neighbours, in either direction, of the `beam` best vertices not yet expanded. It ends when no query has any.
    `vectors` are (id, v, rep), the graph holds one of each group of copies, and copies come in with it.
    """
    copies = vectors.select("rep", "id").withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k)
    vectors = distinct_vectors(vectors)
    asked = cut(queries.select(F.col("query").cast("long").alias("query"), F.col("v").alias("qv")))
    links = graph.select("id", F.explode("near").alias("near"))
    links = cut(links.unionByName(links.select(F.col("near").alias("id"), F.col("id").alias("near"))).distinct())
    gate = vectors.orderBy(F.xxhash64("id"), "id").limit(entries)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = with_cosine(asked.withColumnRenamed("qv", "_va").join(F.broadcast(gate.withColumnRenamed("v", "_vb"))), ["query", "id"]).withColumn("done", F.lit(False))
    found = cut(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= beam).drop("n"))
    for _ in range(rounds):
        open_ = found.filter("NOT done")
        if open_.isEmpty():
            break
        step = open_.select("query", "id").join(links, "id").select("query", F.col("near").alias("id")).distinct().join(found.select("query", "id"), ["query", "id"], "left_anti")
        scored = with_cosine(step.join(vectors.withColumnRenamed("v", "_vb"), "id").join(asked.withColumnRenamed("qv", "_va"), "query"), ["query", "id"]).withColumn("done", F.lit(False))
        every = found.withColumn("done", F.lit(True)).unionByName(scored)
        found = cut(every.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= beam).drop("n"))
    every = found.select("query", F.col("id").alias("rep"), "score").join(copies, "rep")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "id", "score", "rank")


__all__ = ["exact_scores", "greedy_search", "neighbour_graph", "ranked_neighbours", "similar_pairs", "usable_vectors", "with_cosine"]
