"""An inverted index as DataFrames, and BM25 over query trees.

The index holds one row per word, document and field with the word's positions, clustered by word, and one row per document
with its lengths. A query reads only the rows of its words: every leaf of the tree becomes one phrase object (a word, a
prefix, a phrase or a part of NEAR) with its occurrences per document, and the tree is evaluated bottom up by joins on
doc_id, so that a leaf adds to a score only where the part of the tree around it matched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions.analysis import INDEX_WORD, folded, index_tokens
from siftlake.operators.query import And, Field, Fuzzy, Near, Not, Or, Phrase, Prefix, Query, Term, read

# fixed values: the parameters of the ranking
K1, B, TITLE_WEIGHT, LEAST_IDF = 1.2, 0.75, 10.0, 1e-6
#: Partitions of a stored index by the hash of the word.
SHARDS = 64


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, field, positions), lengths (doc_id, size); `tokens` of the text itself for on-the-fly indexes."""

    postings: DataFrame
    lengths: DataFrame

    def save(self, path: str) -> None:
        """Parquet, postings partitioned by shard and sorted by word: a query touches its words' row groups only."""
        shard = F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int").alias("shard")
        self.postings.select("*", shard).repartition(SHARDS, "shard").sortWithinPartitions("shard", "term", "doc_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings").drop("shard"), spark.read.parquet(f"{path}/lengths"))


def build_index(docs: DataFrame, key: str = "doc_id", title: str | None = "title", content: str = "text") -> Index:
    """The index of all documents (repeated keys are one document with all their words). Null and empty texts have no words."""
    named = docs.select(F.col(key).alias("doc_id"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"), F.col(content).alias("content"))
    tokens = named.select("doc_id", index_tokens(F.col("title")).alias("title"), index_tokens(F.col("content")).alias("content"))
    lengths = tokens.groupBy("doc_id").agg(F.sum(F.size("title") + F.size("content")).cast("long").alias("size"))
    words = tokens.select("doc_id", F.explode(F.create_map(F.lit("title"), F.col("title"), F.lit("content"), F.col("content"))).alias("field", "words"))
    each = words.select("doc_id", "field", F.posexplode("words").alias("at", "term"))
    postings = each.groupBy("term", "doc_id", "field").agg(F.sort_array(F.collect_list("at")).alias("positions"))
    return Index(postings, lengths)


def _weighted(field: Column, tf: Column) -> Column:
    return F.when(field == "title", TITLE_WEIGHT).otherwise(1.0) * tf


def _chosen(index: Index, condition: Column, field: str | None) -> DataFrame:
    rows = index.postings.filter(condition)
    return rows.filter(F.col("field") == field) if field else rows


def _phrase(index: Index, words: tuple[str, ...], field: str | None) -> DataFrame:
    """(doc_id, field, positions) where the words stand one after the other; positions are those of the first word."""
    def begun(i: int) -> Column:
        return F.transform("positions", lambda p: p - i).alias(f"p{i}")

    parts = [_chosen(index, F.col("term") == w, field).select("doc_id", "field", begun(i)) for i, w in enumerate(words)]
    joined = reduce(lambda a, b: a.join(b, ["doc_id", "field"]), parts)
    starts = reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(words))])
    return joined.select("doc_id", "field", starts.alias("positions")).filter(F.size("positions") > 0)


def _objects(index: Index, q: Query, field: str | None) -> list[tuple[DataFrame, DataFrame]]:
    """The phrase objects of a leaf: occurrences (doc_id, tf), and the rows that count as holding the object at all."""
    summed = lambda rows: rows.groupBy("doc_id").agg(F.sum(_weighted(F.col("field"), F.size("positions"))).alias("tf"))
    match q:
        case Term(word):
            rows = summed(_chosen(index, F.col("term") == word, field))
        case Prefix(word) | Fuzzy(word, _):
            rows = summed(_chosen(index, F.col("term").startswith(word) if word else F.lit(False), field))
        case Phrase(words):
            rows = summed(_phrase(index, words, field)) if words else summed(_chosen(index, F.lit(False), field))
        case Near(words, distance):
            return _near(index, words, distance, field)
        case _:
            raise TypeError(q)
    return [(rows, rows)]


def _near(index: Index, words: tuple[str, ...], distance: int, field: str | None) -> list[tuple[DataFrame, DataFrame]]:
    """One object per word; only occurrences with every other word within `distance` words in between count."""
    alone = [_chosen(index, F.col("term") == w, field).select("doc_id", "field", F.col("positions").alias(f"p{i}")) for i, w in enumerate(words)]
    joined = reduce(lambda a, b: a.join(b, ["doc_id", "field"]), alone)

    def close(i: int) -> Column:
        def met_all(p: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.exists(f"p{j}", lambda q: (F.abs(p - q) <= distance + 1) & (p != q)) for j in range(len(words)) if j != i])

        return F.size(F.filter(f"p{i}", met_all))

    out = []
    for i in range(len(words)):
        met = joined.select("doc_id", "field", close(i).alias("n")).filter("n > 0")
        rows = met.groupBy("doc_id").agg(F.sum(_weighted(F.col("field"), F.col("n"))).alias("tf"))
        out.append((rows, alone[i].select("doc_id").distinct()))
    return out


def _scored(index: Index, q: Query, field: str | None) -> DataFrame:
    """(doc_id, score) of the documents that match a tree; higher is better."""
    match q:
        case Field(name, inner):
            return _scored(index, inner, name)
        case And(left, Not(right)):
            return _scored(index, left, field).join(_scored(index, right, field).select("doc_id"), "doc_id", "left_anti")
        case Not(inner):
            return index.lengths.select("doc_id", F.lit(0.0).alias("score")).join(_scored(index, inner, field).select("doc_id"), "doc_id", "left_anti")
        case And(left, right):
            a, b = _scored(index, left, field), _scored(index, right, field).withColumnRenamed("score", "score2")
            return a.join(b, "doc_id").select("doc_id", (F.col("score") + F.col("score2")).alias("score"))
        case Or(left, right):
            return _scored(index, left, field).unionByName(_scored(index, right, field)).groupBy("doc_id").agg(F.sum("score").alias("score"))
    corpus = index.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("size").alias("mean"))
    parts = []
    for rows, holding in _objects(index, q, field):
        facts = F.broadcast(holding.agg(F.count(F.lit(1)).alias("df")).crossJoin(corpus))  # one row
        idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col("tf")
        score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        parts.append(rows.join(index.lengths, "doc_id").crossJoin(facts).select("doc_id", score.alias("score")))
    if len(parts) == 1:
        return parts[0]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("doc_id").agg(F.sum("score").alias("score"))


def match(index: Index, query: str | Query, mode: str = "structured", language: str = "en", stemming: bool = True) -> DataFrame:
    """(doc_id, score) of all documents that match; none for an empty query."""
    tree = read(query, mode, language, stemming) if isinstance(query, str) else query
    if tree is None:
        return index.lengths.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    return _scored(index, tree, None)


def top(scored: DataFrame, limit: int = 20, key: str = "doc_id") -> DataFrame:
    """The `limit` best by score, equal ones by key; a limit of 0 or less means 20."""
    return scored.orderBy(F.desc("score"), key).limit(limit if limit > 0 else 20)


def search(index: Index, query: str, limit: int = 20, within: DataFrame | None = None, **how) -> DataFrame:
    """The best documents; `within` (doc_id) is what filters leave, applied after matching, so that it changes no statistic."""
    found = match(index, query, **how)
    if within is not None:
        found = found.join(within.select("doc_id").distinct(), "doc_id", "left_semi")
    return top(found, limit)


def snippet(text: Column, words: list[str], width: int = 40) -> Column:
    """Up to `width` words of a text around the first hit, hits between >>> and <<<, ... where text is left out."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}]+[^\p{L}\p{N}]*"), 0)
    hit = lambda w: F.regexp_extract(folded(w), INDEX_WORD, 0).isin(*words)
    hits = F.transform(parts, hit)
    first = F.array_position(hits, True)
    start = F.greatest(F.lit(1), F.least(first - F.lit(width // 4), F.size(parts) - width + 1)).cast("int")
    shown = F.transform(F.slice(parts, start, width), lambda w: F.when(hit(w), F.regexp_replace(w, r"^([\p{L}\p{N}\p{M}]+)", ">>>$1<<<")).otherwise(w))
    body = F.trim(F.array_join(shown, ""))
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(start + width - 1 < F.size(parts), "...").otherwise("")))


def first_spans(chunks: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line) of each document's first chunk."""
    return chunks.groupBy("doc_id").agg(F.min_by(F.struct("start_line", "end_line"), "seq").alias("s")).select("doc_id", "s.start_line", "s.end_line")


def vocabulary(index: Index) -> DataFrame:
    """(term, df): the distinct words and how many documents hold each."""
    return index.postings.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))


def completions(terms: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """Distinct terms of two signs or more that begin with `prefix` (case counts), ascending; `most` of 0 or less gives all."""
    found = terms.filter((F.length("term") >= 2) & F.col("term").startswith(prefix)).select("term").distinct().orderBy("term")
    return found.limit(most) if most > 0 else found


def ranked(scored: DataFrame, name: str = "rank") -> DataFrame:
    """`scored` with its place from 0 in falling order of score, over one result list."""
    return scored.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1)
