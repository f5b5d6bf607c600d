"""Queries of sources, the store, joins, set operations and windows over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import languages
from siftlake.operators import chunks, embed, fusion, sync
from siftlake.operators.filters import glob_pattern
from siftlake.plans.session import table
from siftlake.sources import files
from siftlake.sources.extract import html_text
from siftlake.sources.schemas import json_at

# --- sources --------------------------------------------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "path", *more)


def s1_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown documents with hash and lines."""
    rows = documents(spark, sf, "text").filter(languages.extension(F.col("path")).isin(*files.ENDINGS["markdown"]) & F.col("text").isNotNull())
    return rows.select("doc_id", F.sha2("text", 256).alias("content_hash"), languages.line_count(F.col("text")).cast("long").alias("line_count"))


def s2_titles(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "text").filter("text IS NOT NULL").select("doc_id", files.markdown_title(F.col("text"), F.col("path")).alias("title"))


def s3_code(spark: SparkSession, sf: str) -> DataFrame:
    """Source files outside ignored folders, as the code scan keeps them."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    kept = documents(spark, sf).filter(languages.language_of(F.col("path")).isNotNull() & ~F.exists(folders, lambda d: d.isin(*languages.IGNORED_FOLDERS) | d.startswith(".")))
    return kept.select("doc_id", languages.language_of(F.col("path")).alias("lang"))


def s6_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a zero byte among the first 1024."""
    return documents(spark, sf, "text").filter("text IS NOT NULL").select("doc_id", (~files._no_zero_byte(F.col("text").cast("binary"))).alias("is_binary"))


_IGNORE = "# notes\nstale-*/\n*.py\nsrc/lazy-index\n"


def s7_ignored(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.lit(False)
    for rule in files.ignore_patterns(_IGNORE):
        hit = hit | F.col("path").rlike(rule)
    return documents(spark, sf).filter(hit).select("doc_id")


def s10_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How many files each kind of scan takes, by ending."""
    ext = languages.extension(F.col("path"))
    kind = F.when(ext.isin(*languages.IMAGE_EXTENSIONS), "image").when(ext == "pdf", "pdf").when(ext.isin(*languages.DOCUMENT_EXTENSIONS), "document").otherwise("none")
    return table(spark, sf, "file_contents", "path").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def s15_names(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with the label of their machine, looked up in a small table."""
    names = table(spark, sf, "machines", "machine_id", "label")
    return table(spark, sf, "sessions", "session_id", "machine_id").distinct().join(names, "machine_id", "left").select("session_id", "label")


def s17_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of all sessions by one join."""
    sessions = table(spark, sf, "sessions", "session_id").distinct()
    return table(spark, sf, "messages", "session_id", "msg_id").join(sessions, "session_id").groupBy("session_id").agg(F.count_distinct("msg_id").alias("n"))


def s20_first_values(spark: SparkSession, sf: str) -> DataFrame:
    """The first role and time that each session's messages state."""
    rows = table(spark, sf, "messages", "session_id", "msg_id", "role").filter("session_id IS NOT NULL AND msg_id IS NOT NULL")
    return rows.groupBy("session_id").agg(F.min_by("role", F.when(F.coalesce("role", F.lit("")) != "", F.struct("msg_id", "role"))).alias("role"))


def s21_present(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables of each stream have a key 'text' or 'content' in any record."""
    rows = table(spark, sf, "session_exports", "stream_id", "table_name", "payload").filter("stream_id IS NOT NULL AND table_name IS NOT NULL")
    has = (json_at(F.col("payload"), "text").isNotNull() | json_at(F.col("payload"), "content").isNotNull()).cast("int")
    return rows.groupBy("stream_id", "table_name").agg(F.max(has).cast("long").alias("has"))


def s22_globs(spark: SparkSession, sf: str) -> DataFrame:
    keep, drop = glob_pattern("work/*.md"), glob_pattern("*/stale-*")
    return documents(spark, sf).filter(F.col("path").rlike(keep) & ~F.col("path").rlike(drop)).select("doc_id")


def s29_html(spark: SparkSession, sf: str) -> DataFrame:
    """The visible text of HTML files."""
    from siftlake.sources.extract import extract

    rows = table(spark, sf, "file_contents", "file_id", "mime_type", "content", "path").filter("mime_type LIKE 'text/html%'").dropDuplicates(["file_id"])
    return extract(rows.withColumn("name", F.lit("page.html")), lambda raw, name: html_text(raw), "file_id").select("file_id", F.length("text").cast("long").alias("n_chars"))


_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LANG = f"map_extract_value(MAP {{{', '.join(f'{e!r}: {v!r}' for e, v in languages.EXTENSIONS.items())}}}, {_EXT})"
SOURCES = {
    "s1_markdown": (s1_markdown, f"SELECT doc_id, sha256(text) AS content_hash, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents WHERE {_EXT} IN ('md', 'markdown') AND text IS NOT NULL"),
    "s2_titles": (
        s2_titles,
        "SELECT doc_id, coalesce(nullif(trim(substr(trim(list_filter(list_slice(string_split(text, chr(10)), 1, 20), lambda x: starts_with(trim(x, ' '), '# '))[1], ' '), 3), ' '), ''), regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')) AS title FROM documents WHERE text IS NOT NULL",
    ),
    "s3_code": (s3_code, f"SELECT doc_id, {_LANG} AS lang FROM documents WHERE {_LANG} IS NOT NULL AND len(list_filter(string_split(path, '/')[:-2], lambda d: d IN {_in(languages.IGNORED_FOLDERS)} OR starts_with(d, '.'))) = 0"),
    "s6_binary": (s6_binary, "SELECT doc_id, contains(substr(hex(encode(text)), 1, 2048), '00') AND regexp_matches(substr(hex(encode(text)), 1, 2048), '^(..)*00') AS is_binary FROM documents WHERE text IS NOT NULL"),
    "s7_ignored": (s7_ignored, "SELECT doc_id FROM documents WHERE path GLOB '*.py' OR regexp_matches(path, '^stale-[^/]*/') OR regexp_matches(path, '(^|/)stale-[^/]*$') OR path = 'src/lazy-index' OR starts_with(path, 'src/lazy-index/')"),
    "s10_kinds": (s10_kinds, f"SELECT CASE WHEN {_EXT} IN {_in(languages.IMAGE_EXTENSIONS)} THEN 'image' WHEN {_EXT} = 'pdf' THEN 'pdf' WHEN {_EXT} IN {_in(languages.DOCUMENT_EXTENSIONS)} THEN 'document' ELSE 'none' END AS kind, count(*) AS n FROM file_contents GROUP BY 1"),
    "s15_names": (s15_names, "SELECT session_id, label FROM (SELECT DISTINCT session_id, machine_id FROM sessions) LEFT JOIN machines USING (machine_id)"),
    "s17_messages": (s17_messages, "SELECT session_id, count(DISTINCT msg_id) AS n FROM messages SEMI JOIN sessions USING (session_id) GROUP BY 1"),
    "s20_first_values": (s20_first_values, "SELECT session_id, arg_min(role, {a: msg_id, b: role}) FILTER (WHERE coalesce(role, '') <> '') AS role FROM messages WHERE session_id IS NOT NULL AND msg_id IS NOT NULL GROUP BY 1"),
    "s21_present": (s21_present, "SELECT stream_id, table_name, max((json_valid(payload) AND coalesce(TRY(payload->>'$.text'), TRY(payload->>'$.content')) IS NOT NULL)::INT)::BIGINT AS has FROM session_exports WHERE stream_id IS NOT NULL AND table_name IS NOT NULL GROUP BY ALL"),
    "s22_globs": (s22_globs, "SELECT doc_id FROM documents WHERE path GLOB 'work/*.md' AND NOT path GLOB '*/stale-*'"),
    "s29_html": (s29_html, None),
}

# --- store, joins, sets ----------------------------------------------------------------------------------------------------


def k1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of even id hold an old title; those of ids divisible by 3 come anew. A known path keeps its created_at."""
    docs = table(spark, sf, "documents", "doc_id", "collection_id", "path", "title", "created_at", "ingested_at")
    old = docs.filter("doc_id % 2 = 0").select("collection_id", "path", F.lit("old").alias("title"), "created_at")
    new = docs.filter("doc_id % 3 = 0").select("collection_id", "path", F.coalesce("title", F.lit("")).alias("_title"), F.col("ingested_at").alias("_at"))
    both = old.join(new, ["collection_id", "path"], "full_outer")
    return both.select("collection_id", "path", F.coalesce("_title", "title").alias("title"), F.coalesce("created_at", "_at").cast("timestamp").alias("created_at"))


def k3_appended(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf, "title", "text")
    return rows.select("doc_id", "title", F.sha2(F.concat_ws("\n", "text", F.lit("more")), 256).alias("hash"))


def k5_without_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks left after the documents of ids divisible by 7 are deleted."""
    gone = documents(spark, sf).filter("doc_id % 7 = 0").select("doc_id")
    return table(spark, sf, "chunk_vectors", "chunk_id", "doc_id").join(gone, "doc_id", "left_anti").select("chunk_id", "doc_id")


def k6_without_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and chunks left in each collection after those of type code are deleted."""
    gone = table(spark, sf, "collections", "collection_id", "coll_type").filter("coll_type = 'code'").select("collection_id")
    docs = table(spark, sf, "documents", "doc_id", "collection_id").join(gone, "collection_id", "left_anti")
    return docs.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_docs"))


def k8_updated(spark: SparkSession, sf: str) -> DataFrame:
    """The times of files after those of odd id were set anew."""
    rows = table(spark, sf, "file_contents", "file_id", "mtime").distinct()
    given = rows.filter("file_id % 2 = 1").select("file_id", F.lit(1.0).alias("_mtime")).distinct()
    return rows.join(given, "file_id", "left").select("file_id", F.coalesce("_mtime", "mtime").alias("mtime")).distinct()


def k9_collections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "collections", "collection_id", "name", "coll_type").orderBy("name")


def k10_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fast fields as rows, gathered for some documents in one go."""
    rows = table(spark, sf, "documents", "doc_id", "lang", "source")
    long = rows.select("doc_id", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("field", "value")).filter("value IS NOT NULL")
    asked = rows.filter("doc_id % 100 = 0").select("doc_id")
    maps = long.join(asked, "doc_id", "left_semi").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    return asked.join(maps, "doc_id", "left").select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))


def j3_with_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with how many chunks they have, none included."""
    found = table(spark, sf, "chunk_vectors", "doc_id", "chunk_id")
    return documents(spark, sf).join(found, "doc_id", "left").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("n"))


def j5_semi(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(table(spark, sf, "chunk_vectors", "doc_id"), "doc_id", "left_semi").select("doc_id")


def j9_both_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents of each query's lists stand in the lexical list, in the vector list, in both."""
    hits = table(spark, sf, "search_hits", "query_id", "branch", "doc_id").filter("query_id IS NOT NULL AND doc_id IS NOT NULL").withColumn("branch", F.lower("branch"))
    one, two = (hits.filter(F.col("branch") == b).select("query_id", "doc_id").distinct().withColumn(b, F.lit(1)) for b in ("lexical", "vector"))
    return one.join(two, ["query_id", "doc_id"], "full_outer").groupBy("query_id").agg(F.count("lexical").alias("lexical"), F.count("vector").alias("vector"), F.count(F.col("lexical") + F.col("vector")).alias("both"))


def u1_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with two texts as two rows, in order."""
    rows = table(spark, sf, "sessions", "session_id", "title", "workspace").distinct()
    halves = F.explode(F.array(F.struct(F.lit(1).alias("half"), F.lit("user").alias("role"), F.col("title").alias("content")), F.struct(F.lit(2).alias("half"), F.lit("assistant").alias("role"), F.col("workspace").alias("content"))))
    return rows.select("session_id", halves.alias("t")).select("session_id", "t.half", "t.role", "t.content").filter("content IS NOT NULL").distinct()


def u2_union(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hits", "query_id", "branch", "doc_id").filter(F.lower("branch").isin("lexical", "vector"))
    return hits.select("query_id", "doc_id").distinct()


def u3_difference(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id").subtract(table(spark, sf, "chunk_vectors", "doc_id"))


def w1_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "search_hits", "query_id", "branch", "doc_id", "chunk_id", "score").filter("lower(branch) = 'vector' AND score IS NOT NULL AND NOT isnan(score)").distinct()
    best = rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max("doc_id").alias("doc_id"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")) - 1).select("query_id", "chunk_id", "doc_id", "rank")


def w3_last_text(spark: SparkSession, sf: str) -> DataFrame:
    """For every message of a session the last user text up to it."""
    from siftlake.queries.engine import talk

    rows = talk(spark, sf).filter("time_created IS NOT NULL").withColumn("text", F.when(F.col("role") == "user", F.col("content")))
    by = Window.partitionBy("session_id").orderBy("time_created", "msg_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("session_id", "msg_id", F.md5(F.substring(F.last(F.nullif("text", F.lit("")), ignorenulls=True).over(by), 1, 500)).alias("context"))


def w6_best_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A document's best chunk in a vector list and what all its chunks add to the fused score."""
    ranks = w1_ranks(spark, sf)
    return ranks.groupBy("query_id", "doc_id").agg(F.min_by("chunk_id", "rank").alias("chunk_id"), F.round(F.sum(1.0 / (F.lit(fusion.RRF_K) + F.col("rank") + 1)), 8).alias("score"))


def c7_json_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "session_exports", "export_id", "payload").filter(F.try_parse_json("payload").isNotNull())
    return rows.select("export_id", json_at(F.col("payload"), "id").alias("id"))


def c12_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunk_vectors", "chunk_id", "doc_id", "seq").filter("doc_id IS NOT NULL AND seq IS NOT NULL").distinct()
    pages = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return rows.withColumn("n", pages).select("chunk_id", chunks.page_text(F.col("doc_id").cast("string"), F.col("seq") + 1, F.col("n"), F.lit("text")).alias("text")).distinct()


def e1_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts embedded by the hash of their words."""
    rows = documents(spark, sf, "text")
    return embed.embedded(rows, embed.hashing_embedder(64), "doc_id", "text").select("doc_id", F.size("embedding").cast("long").alias("n"))


def t5_reranked(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty documents of least id that speak of nightly syncs, ordered by how many of the asked words they hold."""
    rows = table(spark, sf, "documents", "doc_id", "title", "text").filter("text LIKE '%nightly%'").orderBy("doc_id").limit(20).withColumn("score", F.lit(0.0)).withColumnRenamed("text", "content")
    return fusion.rerank(rows, fusion.overlap_scorer, "nightly lunch lock").select("doc_id", F.round("score", 6).alias("score"))


def i7_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each action befalls, by type of collection."""
    from siftlake.queries.engine import listing

    kinds = table(spark, sf, "collections", "collection_id", "coll_type")
    return sync.sync_actions(listing(spark, sf, 8), listing(spark, sf, 5)).join(kinds, "collection_id").groupBy("coll_type", "action").agg(F.count(F.lit(1)).alias("n"))


_RANKS = """v AS (SELECT query_id, chunk_id, max(score) AS score, max(doc_id) AS doc_id FROM (SELECT DISTINCT query_id, doc_id, chunk_id, score FROM search_hits WHERE lower(branch) = 'vector' AND score IS NOT NULL AND NOT isnan(score)) GROUP BY query_id, chunk_id),
r AS (SELECT query_id, chunk_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM v)"""


def _engine():
    from siftlake.queries import engine

    return engine


STORE = {
    "k1_upsert": (
        k1_upsert,
        "SELECT coalesce(o.collection_id, n.collection_id) AS collection_id, coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NOT NULL THEN coalesce(n.title, '') ELSE 'old' END AS title, coalesce(o.created_at, n.ingested_at) AS created_at FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) o FULL JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) n ON o.collection_id = n.collection_id AND o.path = n.path",
    ),
    "k3_appended": (k3_appended, "SELECT doc_id, title, sha256(concat_ws(chr(10), text, 'more')) AS hash FROM documents"),
    "k5_without_documents": (k5_without_documents, "SELECT chunk_id, doc_id FROM chunk_vectors WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0)"),
    "k6_without_collection": (k6_without_collection, "SELECT collection_id, count(*) AS n_docs FROM documents WHERE collection_id IS NULL OR collection_id NOT IN (SELECT collection_id FROM collections WHERE coll_type = 'code') GROUP BY 1"),
    "k8_updated": (k8_updated, "SELECT DISTINCT file_id, CASE WHEN file_id % 2 = 1 THEN 1.0 ELSE mtime END::DOUBLE AS mtime FROM file_contents"),
    "k9_collections": (k9_collections, "SELECT collection_id, name, coll_type FROM collections ORDER BY name"),
    "k10_fields": (k10_fields, "SELECT doc_id, lang, source FROM documents WHERE doc_id % 100 = 0"),
    "j3_with_chunks": (j3_with_chunks, "SELECT d.doc_id, count(DISTINCT chunk_id) AS n FROM documents d LEFT JOIN chunk_vectors c USING (doc_id) GROUP BY 1"),
    "j5_semi": (j5_semi, "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM chunk_vectors)"),
    "j9_both_lists": (
        j9_both_lists,
        "SELECT coalesce(a.query_id, b.query_id) AS query_id, count(a.doc_id) AS lexical, count(b.doc_id) AS vector, count(a.doc_id + b.doc_id) AS both FROM (SELECT DISTINCT query_id, doc_id FROM search_hits WHERE lower(branch) = 'lexical' AND query_id IS NOT NULL AND doc_id IS NOT NULL) a FULL JOIN (SELECT DISTINCT query_id, doc_id FROM search_hits WHERE lower(branch) = 'vector' AND query_id IS NOT NULL AND doc_id IS NOT NULL) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id GROUP BY 1",
    ),
    "u1_turns": (u1_turns, "SELECT session_id, 1 AS half, 'user' AS role, title AS content FROM sessions WHERE title IS NOT NULL UNION SELECT session_id, 2, 'assistant', workspace FROM sessions WHERE workspace IS NOT NULL"),
    "u2_union": (u2_union, "SELECT query_id, doc_id FROM search_hits WHERE lower(branch) = 'lexical' UNION SELECT query_id, doc_id FROM search_hits WHERE lower(branch) = 'vector'"),
    "u3_difference": (u3_difference, "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM chunk_vectors"),
    "w1_ranks": (w1_ranks, f"WITH {_RANKS} SELECT * FROM r"),
    "w3_last_text": (
        w3_last_text,
        f"WITH {_engine()._TALK} SELECT m.session_id AS session_id, msg_id, md5(substr(last_value(CASE WHEN m.role = 'user' THEN nullif(m.content, '') END IGNORE NULLS) OVER (PARTITION BY m.session_id ORDER BY m.time_created, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1, 500)) AS context FROM m WHERE m.time_created IS NOT NULL",
    ),
    "w6_best_chunks": (w6_best_chunks, f"WITH {_RANKS} SELECT query_id, doc_id, arg_min(chunk_id, rank) AS chunk_id, round(sum(1.0 / (60 + rank + 1)), 8) AS score FROM r GROUP BY 1, 2"),
    "c7_json_paths": (c7_json_paths, "SELECT export_id, TRY(payload->>'$.id') AS id FROM session_exports WHERE json_valid(payload)"),
    "c12_pages": (c12_pages, "SELECT DISTINCT chunk_id, printf('Page %d of %d - %s', seq + 1, n, doc_id::VARCHAR) || chr(10) || 'text' AS text FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT chunk_id, doc_id, seq FROM chunk_vectors WHERE doc_id IS NOT NULL AND seq IS NOT NULL))"),
    "e1_embedded": (e1_embedded, "SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s', '', 'g')) <> '' THEN 64 END::BIGINT AS n FROM documents"),
    "t5_reranked": (t5_reranked, None),
    "i7_counts": (
        i7_counts,
        f"SELECT coll_type, action, count(*) AS n FROM (SELECT coalesce(n.collection_id, o.collection_id) AS collection_id, {_engine()._ACTION % 'delete'} AS action FROM {_engine()._listing(8)} n FULL JOIN {_engine()._listing(5)} o ON n.collection_id = o.collection_id AND n.path = o.path) JOIN collections USING (collection_id) GROUP BY 1, 2",
    ),
}

_ALL = SOURCES | STORE
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLE = {k: s for k, (_, s) in _ALL.items() if s}
