"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm import conversations, markup, neighbours, packing, rankwalk, residue, tokens
from siftlake.plans.session import cut, spread, table


def p3_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Every kept conversation, a row per speaking turn, in its order."""
    return conversations.conversations(table(spark, sf, "messages"), table(spark, sf, "sessions", "session_id"))


_FILE = ("file_id", "path", "mime_type", "content", "scanned_at")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.markup_counts(spread(table(spark, sf, "file_contents", *_FILE)))


def p1_text(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean_texts(spread(table(spark, sf, "file_contents", *_FILE)))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.dropped_sessions(table(spark, sf, "messages"), table(spark, sf, "sessions", "session_id"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return cut(neighbours.with_copies(neighbours.usable_vectors(table(spark, sf, "chunk_vectors", "chunk_id", "embedding"))))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return neighbours.similar_pairs(vectors, neighbours.neighbour_graph(neighbours.distinct_vectors(vectors)))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar chunks of every chunk, by a wider graph than near-equal pairs need."""
    vectors = _vectors(spark, sf)
    near = neighbours.ranked_neighbours(vectors, neighbours.neighbour_graph(neighbours.distinct_vectors(vectors), width=24), 10)
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.round("score", 6).alias("score"), "rank")


def p5_search(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy search for every chunk whose id is divisible by 100, against all chunks."""
    vectors = _vectors(spark, sf)
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("query"), "v")
    near = neighbours.greedy_search(vectors, neighbours.neighbour_graph(neighbours.distinct_vectors(vectors), width=24), asked, 11).filter("query <> id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return near.withColumn("rank", rank).filter("rank <= 10").select("query", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return rankwalk.leaders(table(spark, sf, "search_hits"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(spread(table(spark, sf, "documents", "doc_id", "text")), "doc_id", "text")


def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    sized = cut(tokens.encode(spread(table(spark, sf, "documents", "doc_id", "text")), "doc_id", "text", counts_only=True))
    return packing.pack(sized, table(spark, sf, "pack_limits"), "doc_id", "n_tokens")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.condemned(spread(table(spark, sf, "documents", "doc_id", "source", "text")))


QUERIES = {f.__name__: f for f in (p1_found, p1_text, p3_found, p3_conversations, p5_found, p5_neighbours, p5_search, p6_found, p8_ids, p9_packed, p10_found)}

_P5 = """WITH v AS (SELECT chunk_id AS id, max(embedding)::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND chunk_id IS NOT NULL GROUP BY chunk_id),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
near AS (SELECT a.id, b.id AS other, list_dot_product(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) AS n FROM u a JOIN u b ON a.id <> b.id)
SELECT DISTINCT least(id, other) AS chunk_a, greatest(id, other) AS chunk_b FROM near WHERE n <= 10 AND s >= 0.9"""

#: The others are iterative, depend on Python text rules or on a vocabulary file; tests compare them with brute force or round trips.
ORACLE: dict[str, str] = {"p5_found": _P5}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
