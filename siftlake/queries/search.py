"""Queries of the search engine over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.analysis import analyzed, index_tokens, query_tokens, without_stops
from siftlake.operators import filters, fusion, lexical, vector
from siftlake.operators.lexical import Index
from siftlake.plans.session import table

TOP = 20
WORDS = r"[\p{L}\p{N}]+"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "title", "text")


def index(spark: SparkSession, sf: str) -> Index:
    return lexical.build_index(documents(spark, sf))


def rounded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("score", 6).alias("score"))


def asking(text: str, **how):
    """A query that returns the best documents for a query string."""
    return lambda spark, sf: rounded(lexical.search(index(spark, sf), text, TOP, **how))


def filtered(text: str, chosen: filters.FilterSet):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = filters.with_collections(table(spark, sf, "documents", "doc_id", "collection_id", "path", "lang", "created_at"), table(spark, sf, "collections"))
        return rounded(lexical.search(index(spark, sf), text, TOP, chosen.apply(docs)))

    return run


# --- the same in SQL: words of a text, occurrences of a leaf, its score ---------------------------------------------------

_DOCS = rf"""docs AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(replace(coalesce(title, ''), 'İ', 'I')), '\p{{M}}', '', 'g'), '{WORDS}') AS tt,
 regexp_extract_all(regexp_replace(lower(replace(coalesce(text, ''), 'İ', 'I')), '\p{{M}}', '', 'g'), '{WORDS}') AS ct FROM documents),
facts AS (SELECT count(*) AS n, avg(len(tt) + len(ct)) AS mean FROM docs)"""


def _occurs(words: str, test: str) -> str:
    """How often a test over (w, i) holds in a list of words."""
    return f"len(list_filter(range(1, len({words}) + 1), lambda i: {test.replace('@', words)}))"


def leaf(name: str, test: str, field: str | None = None, holds: str | None = None) -> str:
    """CTEs for the scores of one leaf; `holds` is the test that a document counts by, if another."""
    title = "0" if field == "content" else _occurs("tt", test)
    content = "0" if field == "title" else _occurs("ct", test)
    count = f"sum((({'0' if field == 'content' else _occurs('tt', holds)}) + ({'0' if field == 'title' else _occurs('ct', holds)}) > 0)::INT)" if holds else "sum((tf > 0)::INT)"
    return f"""{name}_tf AS (SELECT doc_id, 10.0 * {title} + {content} AS tf, len(tt) + len(ct) AS d, tt, ct FROM docs),
{name}_df AS (SELECT {count} AS df FROM {name}_tf),
{name} AS (SELECT doc_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / mean)) AS score FROM {name}_tf, {name}_df, facts WHERE tf > 0)"""


def is_word(w: str) -> str:
    return f"@[i] = '{w}'"


def begins(w: str) -> str:
    return f"starts_with(@[i], '{w}')"


def phrase(*words: str) -> str:
    return " AND ".join(f"@[i + {k}] = '{w}'" if k else f"@[i] = '{w}'" for k, w in enumerate(words))


def near(word: str, other: str, distance: int) -> str:
    return f"@[i] = '{word}' AND len(list_filter(range(1, len(@) + 1), lambda j: @[j] = '{other}' AND abs(i - j) <= {distance + 1} AND i <> j)) > 0"


def ranked(leaves: list[str], scored: str, more: str = "") -> str:
    return f"WITH {_DOCS}, {', '.join(leaves)} SELECT s.doc_id, round(score, 6) AS score FROM ({scored}) s {more} ORDER BY score DESC, s.doc_id LIMIT {TOP}"


_A, _B = leaf("a", is_word("nightly")), leaf("b", is_word("sync"))
_AND = "SELECT a.doc_id, a.score + b.score AS score FROM a JOIN b USING (doc_id)"
_OR = "SELECT doc_id, sum(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id"

LEXICAL = {
    "r1_bm25_term": (asking("shard"), ranked([leaf("a", is_word("shard"))], "SELECT * FROM a")),
    "q1_term_stemmed": (asking("numbers"), ranked([leaf("a", begins("number"))], "SELECT * FROM a")),
    "q2_phrase": (asking('"nightly sync"'), ranked([leaf("a", phrase("nightly", "sync"))], "SELECT * FROM a")),
    "q3_prefix": (asking("glos*", stemming=False), ranked([leaf("a", begins("glos"))], "SELECT * FROM a")),
    "q4_fuzzy": (asking("ledge~2", stemming=False), ranked([leaf("a", begins("ledge"))], "SELECT * FROM a")),
    "q5_field_title": (asking("title:stemmer", stemming=False), ranked([leaf("a", is_word("stemmer"), "title")], "SELECT * FROM a")),
    "q5_field_content": (asking("content:watermark"), ranked([leaf("a", is_word("watermark"), "content")], "SELECT * FROM a")),
    "q6_near": (
        asking("NEAR(surprised nightly, 3)"),
        ranked(
            [leaf("a", near("surprised", "nightly", 3), holds=is_word("surprised")), leaf("b", near("nightly", "surprised", 3), holds=is_word("nightly"))], _OR
        ),
    ),
    "q7_and": (asking("lunch AND sync", stemming=False), ranked([leaf("a", is_word("lunch")), _B], _AND)),
    "q8_or": (asking("nightly OR sync", stemming=False), ranked([_A, _B], _OR)),
    "q9_not": (asking("sync AND NOT shard", stemming=False), ranked([leaf("a", is_word("shard")), _B], "SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")),
    "q9_not_alone": (asking("NOT sync", stemming=False), ranked([_B], "SELECT doc_id, 0.0 AS score FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM b)")),
    "q10_parentheses": (
        asking("(nightly AND sync) OR ledger", stemming=False),
        ranked([_A, _B, leaf("c", is_word("ledger"))], f"SELECT doc_id, sum(score) AS score FROM ({_AND} UNION ALL SELECT * FROM c) GROUP BY doc_id"),
    ),
    "q12_broken_goes_raw": (asking("spare sync"), ranked([leaf("a", is_word("spare")), _B], _AND)),
    "q13_raw": (asking("spare sync", mode="raw"), ranked([leaf("a", is_word("spare")), _B], _AND)),
    "q14_empty": (asking("  "), "SELECT doc_id, 0.0 AS score FROM documents WHERE false"),
}

_IN = "JOIN documents d ON d.doc_id = s.doc_id JOIN collections c ON c.collection_id = d.collection_id WHERE "
FILTERED = {
    "f1_collection": (filters.FilterSet(collection="nosuch"), "c.name = 'nosuch'"),
    "f2_coll_type": (filters.FilterSet(coll_type="code"), "c.coll_type = 'code'"),
    "f3_dates": (filters.FilterSet(since="2024-02-01T00:00:00Z", until="2025-02-01"), "strftime(d.created_at, '%Y-%m-%dT%H:%M:%SZ') BETWEEN '2024-02-01T00:00:00Z' AND '2025-02-01'"),
    "f5_path_glob": (filters.FilterSet(path="*/stale-*/*.md"), "d.path GLOB '*/stale-*/*.md'"),
    "f6_fast_field": (filters.FilterSet(fields=(("lang", "EN"),)), "lower(d.lang) = 'en'"),
    "f7_conjunction": (filters.FilterSet(coll_type="markdown", path="[a-n]*", fields=(("lang", "en"),)), "c.coll_type = 'markdown' AND d.path GLOB '[a-n]*' AND lower(d.lang) = 'en'"),
}


def j1_hits_with_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The best hits with title, path and collection, and the place they are shown under."""
    docs = filters.with_collections(table(spark, sf, "documents", "doc_id", "collection_id", "title", "path"), table(spark, sf, "collections"))
    found = rounded(lexical.search(index(spark, sf), "shard", TOP))
    shown = filters.location(F.col("path"), F.lit(0), F.lit(0), "work")
    return found.join(docs, "doc_id").select("doc_id", "score", "title", "collection", shown.alias("location"))


def r2_snippets(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.search(index(spark, sf), "shard", TOP).select("doc_id")
    return found.join(documents(spark, sf), "doc_id").select("doc_id", lexical.snippet(F.col("text"), ["shard"]).alias("snippet"), filters.shown_text(F.col("text")).alias("line"))


def a8_index_words(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents hold each of the words of their texts."""
    words = documents(spark, sf).select("doc_id", F.explode(F.array_distinct(index_tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def a1_query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.size(query_tokens(F.col("text"))).cast("long").alias("n_tokens"))


def a3_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.transform(query_tokens(F.col("text")), lambda w: F.lower(w))
    return documents(spark, sf).select("doc_id", F.size(without_stops(tokens, "en")).cast("long").alias("n_kept"))


def a5_analyzed(spark: SparkSession, sf: str) -> DataFrame:
    """The stems of all texts with how often each occurs."""
    words = documents(spark, sf).select(F.explode(analyzed(F.col("text"), "en", True, False)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    from siftlake.functions.analysis import stems

    return words.select(stems(F.array("word"), "en")[0].alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


def t9_completions(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.completions(lexical.vocabulary(index(spark, sf)), "re", 10)


def g10_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.vocabulary(index(spark, sf))


# --- vectors and hybrid search --------------------------------------------------------------------------------------------


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Usable vectors, a chunk once."""
    rows = table(spark, sf, "chunk_vectors", "chunk_id", "doc_id", "embedding")
    good = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(good).groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"), F.max("embedding").alias("embedding"))


def asked_vector(spark: SparkSession, sf: str) -> list[float]:
    """The query of the vector examples: the first of the table `embeddings`."""
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"])


def nearest_vectors(where: str = "true", search=vector.nearest):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, "embeddings").filter(where)
        return search(rows, asked_vector(spark, sf), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))

    return run


def v2_chunks_of_language(spark: SparkSession, sf: str) -> DataFrame:
    """The ten chunks nearest to a vector among the documents of one language."""
    docs = table(spark, sf, "documents", "doc_id", "lang").filter("lang = 'en'")
    found = vector.nearest(chunks(spark, sf).join(docs, "doc_id"), asked_vector(spark, sf), 10)
    return found.select("chunk_id", "doc_id", F.round("score", 6).alias("score"))


def v8_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written to blobs and read back."""
    rows = table(spark, sf, "embeddings", "vec_id", "embedding")
    back = rows.withColumn("embedding", vector.decode_blob(vector.encode_blob(F.col("embedding"))))
    return back.select("vec_id", F.size("embedding").cast("long").alias("n"), F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))


def hybrid_search(spark: SparkSession, sf: str, limit: int = 10) -> DataFrame:
    words = lexical.search(index(spark, sf), "shard OR watermark", fusion.candidates_of(limit), stemming=False)
    near_ = vector.nearest(chunks(spark, sf), asked_vector(spark, sf), fusion.candidates_of(limit))
    return fusion.hybrid(words, near_, limit).select("doc_id", F.round("score", 8).alias("score"))


def branch(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One branch of search_hits as ranked lists: a document's best score per query, from place 0."""
    from pyspark.sql import Window

    hits = table(spark, sf, "search_hits", "query_id", "branch", "doc_id", "score").filter((F.lower("branch") == name) & F.col("score").isNotNull() & ~F.isnan("score"))
    best = hits.groupBy("query_id", "doc_id").agg((F.min if name == "lexical" else F.max)("score").alias("score"))
    order = F.asc("score") if name == "lexical" else F.desc("score")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "doc_id")) - 1)


def t3_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion of the lexical and the vector list of every query."""
    from pyspark.sql import Window

    both = branch(spark, sf, "lexical").unionByName(branch(spark, sf, "vector"))
    fused = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.lit(fusion.RRF_K) + F.col("rank") + 1)).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.round("score", 10).desc(), "doc_id")
    return fused.withColumn("place", F.row_number().over(by)).filter("place <= 10").select("query_id", "doc_id", F.round("score", 8).alias("score"))


def t2_sort(descending: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = table(spark, sf, "documents", "doc_id", "n_chars")
        found = fusion.with_rank(lexical.search(index(spark, sf), "shard", 50), F.desc("score"), "doc_id")
        values = docs.filter("n_chars % 2 = 0").select("doc_id", F.col("n_chars").alias("value"))
        return fusion.sort_by_field(found, values, descending).limit(10).select("doc_id", "value")

    return run


_VECTORS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0)"
_CHUNKS = """chunks AS (SELECT chunk_id, max(doc_id) AS doc_id, max(embedding) AS embedding FROM chunk_vectors WHERE len(embedding) = 64
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY chunk_id), q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0)"""
_COSINE = "list_dot_product(e, qe) / sqrt(list_dot_product(e, e) * list_dot_product(qe, qe))"
_CHUNK_COSINE = "coalesce(list_dot_product(embedding::DOUBLE[], qe) / nullif(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(qe, qe)), 0), 0)"
_BRANCH = """b AS (SELECT query_id, lower(branch) AS branch, doc_id, CASE WHEN lower(branch) = 'lexical' THEN -min(score) ELSE max(score) END AS score FROM search_hits
 WHERE lower(branch) IN ('lexical', 'vector') AND score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, lower(branch), doc_id),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, doc_id) - 1 AS rank FROM b)"""

VECTORS = {
    "v1_cosine": (nearest_vectors(), f"WITH {_VECTORS} SELECT vec_id, round({_COSINE}, 6) AS score FROM v, q ORDER BY {_COSINE} DESC, vec_id LIMIT 10"),
    "v4_filtered": (nearest_vectors("label = 3"), f"WITH {_VECTORS} SELECT vec_id, round({_COSINE}, 6) AS score FROM v, q WHERE label = 3 ORDER BY {_COSINE} DESC, vec_id LIMIT 10"),
    "v3_approximate": (nearest_vectors(search=vector.approximate), None),
    "v2_chunks_of_language": (
        v2_chunks_of_language,
        f"WITH {_CHUNKS} SELECT chunk_id, doc_id, round({_CHUNK_COSINE}, 6) AS score FROM chunks JOIN documents USING (doc_id), q WHERE lang = 'en' ORDER BY {_CHUNK_COSINE} DESC, chunk_id LIMIT 10",
    ),
    "v8_blobs": (v8_blobs, "SELECT vec_id, len(embedding)::BIGINT AS n, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings"),
    "t4_hybrid_search": (
        hybrid_search,
        f"""WITH {_DOCS}, {leaf('a', is_word('shard'))}, {leaf('b', is_word('watermark'))}, words AS ({_OR}), {_CHUNKS},
 lw AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM words QUALIFY rank < 20),
 lv AS (SELECT doc_id, row_number() OVER (ORDER BY {_CHUNK_COSINE} DESC, chunk_id) - 1 AS n, row_number() OVER (ORDER BY {_CHUNK_COSINE} DESC, doc_id, chunk_id) - 1 AS rank FROM chunks, q QUALIFY n < 20)
 SELECT doc_id, round(sum(1.0 / (60 + rank + 1)), 8) AS score FROM (SELECT doc_id, rank FROM lw UNION ALL SELECT doc_id, rank FROM lv) GROUP BY doc_id ORDER BY sum(1.0 / (60 + rank + 1)) DESC, doc_id LIMIT 10""",
    ),
    "t3_rrf": (
        t3_rrf,
        f"""WITH {_BRANCH}, f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank + 1)) AS score FROM r GROUP BY query_id, doc_id)
 SELECT query_id, doc_id, round(score, 8) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) <= 10""",
    ),
    "t2_sort_ascending": (t2_sort(False), None),
    "t2_sort_descending": (t2_sort(True), None),
}
_TOP50 = f"WITH {_DOCS}, {leaf('a', is_word('shard'))}, t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a QUALIFY rank <= 50) SELECT t.doc_id, n_chars AS value FROM t LEFT JOIN (SELECT * FROM documents WHERE n_chars % 2 = 0) d USING (doc_id)"
for _name, _order in (("ascending", "ASC"), ("descending", "DESC")):
    VECTORS[f"t2_sort_{_name}"] = (VECTORS[f"t2_sort_{_name}"][0], f"{_TOP50} ORDER BY value {_order} NULLS LAST, rank LIMIT 10")

_WORDS_OF = rf"regexp_extract_all(regexp_replace(strip_accents(lower(replace(coalesce(text, ''), 'İ', 'I'))), '\p{{M}}', '', 'g'), '{WORDS}')"
_STOPPED = "list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nd}_]+'), lambda w: lower(w)), lambda w: NOT list_contains([%s], w))"
OTHERS = {
    "a1_query_tokens": (a1_query_tokens, r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nd}_]+'))::BIGINT AS n_tokens FROM documents"),
    "a3_stop_words": (a3_stop_words, None),
    "a5_analyzed": (a5_analyzed, None),
    "a8_index_words": (a8_index_words, f"SELECT w AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS_OF}) AS w FROM documents) GROUP BY w"),
    "g10_vocabulary": (
        g10_vocabulary,
        f"SELECT w AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS_OF}) AS w FROM documents UNION ALL SELECT doc_id, unnest({_WORDS_OF.replace('text', 'title')}) AS w FROM documents) GROUP BY w",
    ),
    "t9_completions": (t9_completions, None),
    "j1_hits_with_documents": (
        j1_hits_with_documents,
        ranked([leaf("a", is_word("shard"))], "SELECT * FROM a").replace("WITH docs", "WITH RECURSIVE docs", 1).join(["SELECT t.doc_id, score, title, name AS collection, CASE WHEN starts_with(d.path, 'work/') THEN '~' || substr(d.path, 5) ELSE d.path END AS location FROM (", ") t JOIN documents d USING (doc_id) JOIN collections c USING (collection_id)"]),
    ),
    "r2_snippets": (r2_snippets, None),
}


def _stops() -> str:
    from siftlake.functions.analysis import ENGLISH_STOPS

    return ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOPS))


OTHERS["a3_stop_words"] = (a3_stop_words, f"SELECT doc_id, len({_STOPPED % _stops()})::BIGINT AS n_kept FROM documents")

_ALL = LEXICAL | {k: (filtered("shard", f), ranked([leaf("a", is_word("shard"))], "SELECT * FROM a", _IN + sql)) for k, (f, sql) in FILTERED.items()} | VECTORS | OTHERS
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLE = {k: s for k, (_, s) in _ALL.items() if s}
