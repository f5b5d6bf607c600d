"""Reciprocal rank fusion, hybrid search, re-ranking and sorting of results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the constant of the fusion, and what a limit of 0 or less means
RRF_K, LIMIT, CLI_LIMIT = 60, 20, 10


def limit_of(limit: int | None, default: int = LIMIT) -> int:
    return limit if limit and limit > 0 else default


def candidates_of(limit: int, reranked: bool = False) -> int:
    """How many rows each branch of a hybrid search hands to the fusion."""
    return limit_of(limit) * (3 if reranked else 2)


def with_rank(results: DataFrame, *order) -> DataFrame:
    """Place from 0 within one result list; a list is as long as its limit, so one task orders it."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(lists: Sequence[DataFrame], k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """(key, score) of ranked lists (key, rank from 0): the sum of 1 / (k + rank + 1), best first, equal scores by key.

    A key that a list holds more than once (several chunks of a document) adds each of its places.
    """
    every = lists[0].select(key, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score")).orderBy(F.desc("score"), key)


def fuse_with_rows(lexical: DataFrame, vector: DataFrame, k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """`fuse` of two lists with their other columns; where both know a document the lexical row is taken, else its best vector row."""
    scored = fuse([lexical, vector], k, key)
    rows = lexical.withColumn("_list", F.lit(0)).unionByName(vector.withColumn("_list", F.lit(1)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (key, "rank", "score", "_list")]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("_list", "rank")).alias("_row")) if others else rows.select(key).distinct().withColumn("_row", F.struct())
    return scored.join(first, key).select(key, "score", *[f"_row.{c}" for c in others]).orderBy(F.desc("score"), key)


def hybrid(lexical: DataFrame, vector: DataFrame | None, limit: int = LIMIT, k: int = RRF_K, key: str = "doc_id", rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best documents of a lexical list (key, score) and a vector list of chunks (key, chunk_id, score), fused by rank.

    Without a vector list the lexical order stands. A re-ranker sees the fused candidates once and its scores replace theirs.
    """
    n = candidates_of(limit, rerank is not None)
    words = with_rank(lexical.orderBy(F.desc("score"), key).limit(n), F.desc("score"), key)
    if vector is None:
        fused = words.select(key, "score")
    else:
        ties = [c for c in ("chunk_id",) if c in vector.columns]
        near = with_rank(vector.orderBy(F.desc("score"), key, *ties).limit(n), F.desc("score"), key, *ties)
        fused = fuse([words, near], k, key)
    fused = fused.orderBy(F.desc("score"), key).limit(n)
    if rerank is not None:
        fused = rerank(fused)
    return fused.orderBy(F.desc("score"), key).limit(limit_of(limit))


def rerank(results: DataFrame, scorer: Callable[[str, list[str]], list[tuple[int, float]]], query: str, key: str = "doc_id", title: str = "title", content: str = "content", top_n: int | None = None) -> DataFrame:
    """The rows of one short result list, re-scored by `scorer(query, texts)` -> [(index, score)].

    The text of a row is its title and content on two lines. One row or none, a failing scorer and an empty answer leave the
    order as it is; answers with an index outside the list are dropped. The list is at most as long as the search's limit.
    """
    rows = results.collect()
    if len(rows) <= 1:
        return results
    texts = [f"{r[title] or ''}\n{r[content] or ''}" for r in rows]
    try:
        answer = [(i, s) for i, s in scorer(query, texts) if 0 <= i < len(rows)]
    except Exception:  # a re-ranker is a service: searching goes on without it
        answer = []
    if not answer:
        return results
    answer = sorted(answer, key=lambda x: -x[1])[: top_n or len(answer)]
    spark = results.sparkSession
    return spark.createDataFrame([{**rows[i].asDict(), "score": float(s)} for i, s in answer], results.drop("score").schema.add("score", "double"))


def overlap_scorer(query: str, texts: list[str]) -> list[tuple[int, float]]:
    """A re-ranker that needs no service: the share of the query's words that a text holds."""
    from siftlake.functions.analysis import index_words

    asked = set(index_words(query))
    return [(i, len(asked & set(index_words(t))) / max(len(asked), 1)) for i, t in enumerate(texts)]


def sort_by_field(results: DataFrame, values: DataFrame, descending: bool = False, key: str = "doc_id", value: str = "value", rank: str = "rank") -> DataFrame:
    """Results by a field, rows without a value last in both directions, equal values in the order of their rank."""
    joined = results.join(values.select(key, F.col(value).alias("_value")), key, "left")
    order = F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_last()
    return joined.orderBy(order, rank, key).withColumnRenamed("_value", value)
