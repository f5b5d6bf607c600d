"""Similarity of vectors: exact top-k with filters, and an approximate index by random hyperplanes."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Planes of a hash table and tables of the approximate index.
PLANES, TABLES = 8, 12


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where lengths differ, a vector is null or empty, has no length, or holds NaN."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    square = lambda v: total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    c = dot / F.nullif(F.sqrt(square(a)) * F.sqrt(square(b)), F.lit(0.0))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


def check_dimension(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Rows whose vector has another dimension fail the job, as adding them to an index does."""
    wrong = F.raise_error(F.concat(F.lit(f"dimension {dimension} expected, not "), F.size(vector).cast("string")))
    return vectors.filter(F.when(F.size(vector) == dimension, F.lit(True)).otherwise(wrong.cast("boolean")))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """All columns but the vector with `score`: the k rows most similar to `query`, equal scores by key.

    Filters are applied to `vectors` before: the result has k rows if so many remain. Rows without vector do not take part.
    """
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.col(vector).isNotNull()).withColumn("score", cosine(F.col(vector).cast("array<double>"), asked))
    return scored.drop(vector).orderBy(F.desc("score"), key).limit(k)


def nearest_for_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) for a set of queries (query_id, q), broadcast: keep the set small. `vectors` is (id, v)."""
    pairs = vectors.join(F.broadcast(queries)).select("query_id", "id", cosine(F.col("v"), F.col("q")).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).drop("n")


def plane_hashes(vector: Column, dimension: int, planes: int = PLANES, tables: int = TABLES) -> Column:
    """One hash per table: the sides of `planes` random planes on which a vector lies. The planes follow from their numbers alone."""

    def side(table: int, plane: int) -> Column:
        weight = lambda i: F.pmod(F.xxhash64(i, F.lit(table), F.lit(plane)), F.lit(2001)).cast("double") - 1000.0
        along = F.aggregate(F.zip_with(vector, F.sequence(F.lit(1), F.lit(dimension)), lambda x, i: x.cast("double") * weight(i)), F.lit(0.0), lambda a, x: a + x)
        return F.when(along >= 0, 1 << plane).otherwise(0)

    return F.array(*[sum((side(t, p) for p in range(1, planes)), side(t, 0)) for t in range(tables)])


def approximate(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding", planes: int = PLANES, tables: int = TABLES) -> DataFrame:
    """`nearest` among the rows that share a hash with the query in any table; where these are fewer than k, among all rows."""
    dimension = len(query)
    asked = plane_hashes(F.array(*[F.lit(float(x)) for x in query]), dimension, planes, tables)
    hashed = vectors.filter(F.size(vector) == dimension).withColumn("_h", plane_hashes(F.col(vector), dimension, planes, tables))
    near = hashed.filter(F.exists(F.zip_with("_h", asked, lambda a, b: a == b), lambda x: x)).drop("_h")
    found = nearest(near, query, k, key, vector).withColumn("_near", F.lit(0))
    rest = nearest(vectors, query, k, key, vector).withColumn("_near", F.lit(1))
    one = found.unionByName(rest).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_near")))
    return one.filter("_n = 1").orderBy("_near", F.desc("score"), key).limit(k).drop("_near", "_n") if k > 0 else found.limit(0).drop("_near")


def decode_blob(column: Column) -> Column:
    """A vector from its little-endian 32-bit floats; null for null or a length that is no multiple of 4."""

    @F.arrow_udf("array<float>")
    def run(blobs):
        import pyarrow as pa

        return pa.array([None if b is None or len(b) % 4 else list(struct.unpack(f"<{len(b) // 4}f", b)) for b in blobs.to_pylist()], pa.list_(pa.float32()))

    return run(column)


def encode_blob(column: Column) -> Column:
    """The little-endian 32-bit floats of a vector."""

    @F.arrow_udf("binary")
    def run(vectors):
        import pyarrow as pa

        return pa.array([None if v is None else struct.pack(f"<{len(v)}f", *v) for v in vectors.to_pylist()], pa.binary())

    return run(column)


INDEX_KINDS = {"linear": nearest, "hnsw": approximate}


def index_of(kind: str | None):
    """The search of an index kind; an unknown kind is searched exactly."""
    return INDEX_KINDS.get((kind or "").lower(), nearest)
