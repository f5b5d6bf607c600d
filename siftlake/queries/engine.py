"""Queries of facets, filters, sync, chunks and windows over the test tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import languages
from siftlake.operators import changes, chunks, facets, filters, sync
from siftlake.plans.session import table

# --- facets ---------------------------------------------------------------------------------------------------------------


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with what their collection says."""
    return filters.with_collections(table(spark, sf, "documents", "doc_id", "collection_id", "path", "lang", "source", "n_chars", "created_at"), table(spark, sf, "collections"))


def faceted(spec: str, of=described):
    return lambda spark, sf: facets.facet(of(spark, sf), spec)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


_DESCRIBED = "documents d JOIN collections c USING (collection_id)"


def _terms(column: str, source: str = _DESCRIBED) -> str:
    return f"SELECT {column}::VARCHAR AS key, count(*) AS count FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"


def _periods(column: str, form: str, source: str) -> str:
    return f"SELECT strftime({column}, '{form}') AS key, count(*) AS count FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY 1"


def _ranges(column: str, cases: str, source: str) -> str:
    return f"SELECT CASE {cases.replace('@', column)} ELSE 'other' END AS key, count(*) AS count FROM {source} GROUP BY 1 ORDER BY 1"


def g6_many(spark: SparkSession, sf: str) -> DataFrame:
    """Several facets at once, as (spec, key, count)."""
    parts = facets.facets(described(spark, sf), ["lang:terms", "created_at:histogram:year", "count"])
    out = None
    for spec, rows in parts.items():
        named = rows.select(F.lit(spec).alias("spec"), "key", "count")
        out = named if out is None else out.unionByName(named)
    return out


FACETS = {
    "g1_terms_collection": (faceted("collection:terms"), _terms("c.name")),
    "g1_terms_type": (faceted("type:terms"), _terms("c.coll_type")),
    "g1_terms_lang": (faceted("lang:terms"), _terms("d.lang")),
    "g2_histogram_day": (faceted("ts:histogram:day", events), _periods("ts", "%Y-%m-%d", "events")),
    "g2_histogram_week": (faceted("ts:histogram:week", events), _periods("ts", "%Y-%W", "events")),
    "g2_histogram_month": (faceted("o_orderdate:histogram", orders), _periods("o_orderdate", "%Y-%m", "orders")),
    "g2_histogram_year": (faceted("date:histogram:year"), _periods("d.created_at", "%Y", _DESCRIBED)),
    "g3_range_default": (faceted("n_chars:range"), _ranges("n_chars", "WHEN @ >= 0 AND @ < 100 THEN '0-100' WHEN @ >= 100 AND @ < 500 THEN '100-500' WHEN @ >= 500 THEN '500-'", _DESCRIBED)),
    "g3_range_given": (faceted("n_chars:range:0-1000,1000-5000"), _ranges("n_chars", "WHEN @ >= 0 AND @ < 1000 THEN '0-1000' WHEN @ >= 1000 AND @ < 5000 THEN '1000-5000'", _DESCRIBED)),
    "g4_count": (faceted("count"), f"SELECT 'count' AS key, count(*) AS count FROM {_DESCRIBED}"),
    "g6_many": (
        g6_many,
        f"SELECT 'lang:terms' AS spec, lang AS key, count(*) AS count FROM documents WHERE lang IS NOT NULL AND collection_id IN (SELECT collection_id FROM collections) GROUP BY ALL UNION ALL SELECT 'created_at:histogram:year', strftime(d.created_at, '%Y'), count(*) FROM {_DESCRIBED} WHERE d.created_at IS NOT NULL GROUP BY ALL UNION ALL SELECT 'count', 'count', count(*) FROM {_DESCRIBED}",
    ),
}

# --- filters and projections on chunks -------------------------------------------------------------------------------------


def f8_pending(spark: SparkSession, sf: str) -> DataFrame:
    return filters.pending(table(spark, sf, "chunk_vectors", "chunk_id", "doc_id", "seq", "embedding")).select("chunk_id", "doc_id", "seq")


def f9_defaults(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "file_contents", "file_id", "line_count", "title").withColumn("start_line", F.when(F.col("line_count") % 2 == 0, 1)).withColumn("image_path", F.lit(None).cast("string"))
    return filters.with_defaults(rows).groupBy("start_line", "image_path").agg(F.count(F.lit(1)).alias("n"))


def f10_validity(spark: SparkSession, sf: str) -> DataFrame:
    """How many payloads are JSON, and how many of their collections' dates are dates."""
    ok = filters.valid(F.col("payload"), "json")
    return table(spark, sf, "session_exports", "payload").agg(F.sum(ok.cast("long")).alias("valid"), F.count(F.lit(1)).alias("n"))


def f11_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_contents", "file_id", "content").distinct().select("file_id", filters.shown_text(F.col("content")).alias("line"))


def f12_locations(spark: SparkSession, sf: str) -> DataFrame:
    where = filters.location(F.col("path"), F.lit(1), F.col("line_count"), "notes")
    return table(spark, sf, "file_contents", "file_id", "path", "line_count").distinct().select("file_id", where.alias("location"))


FILTERS = {
    "f8_pending": (f8_pending, "SELECT chunk_id, doc_id, seq FROM chunk_vectors WHERE embedding IS NULL"),
    "f9_defaults": (f9_defaults, "SELECT CASE WHEN line_count % 2 = 0 THEN 1 ELSE 0 END AS start_line, '' AS image_path, count(*) AS n FROM file_contents GROUP BY ALL"),
    "f10_validity": (f10_validity, "SELECT sum((payload IS NULL OR json_valid(payload))::BIGINT)::BIGINT AS valid, count(*) AS n FROM session_exports"),
    "f11_lines": (f11_lines, r"SELECT file_id, CASE WHEN length(l) > 200 THEN substr(l, 1, 200) || '...' ELSE l END AS line FROM (SELECT DISTINCT file_id, trim(regexp_replace(content, '\s+', ' ', 'g'), ' ') AS l FROM file_contents)"),
    "f12_locations": (
        f12_locations,
        "SELECT file_id, (CASE WHEN starts_with(path, 'notes/') THEN '~' || substr(path, 6) ELSE path END) || ':L1-L' || line_count AS location FROM (SELECT DISTINCT file_id, path, line_count FROM file_contents)",
    ),
}

# --- sync ------------------------------------------------------------------------------------------------------------------


def listing(spark: SparkSession, sf: str, run_no: int) -> DataFrame:
    """What a run listed: the latest row per path, as (collection_id, path, content_hash, mtime)."""
    runs = table(spark, sf, "sync_runs", "run_id", "collection_id", "run_no").filter(F.col("run_no") == run_no).select("run_id")
    rows = table(spark, sf, "scan_entries", "run_id", "collection_id", "path", "content_hash", "mtime", "seen_at", "entry_id").join(runs, "run_id")
    newest = F.max_by(F.struct("content_hash", "mtime"), F.struct("seen_at", "entry_id")).alias("s")
    return rows.filter("path IS NOT NULL").groupBy("collection_id", "path").agg(newest).select("collection_id", "path", "s.content_hash", "s.mtime")


def _listing(run_no: int) -> str:
    return f"(SELECT e.collection_id, e.path, arg_max({{content_hash: content_hash, mtime: mtime}}, {{a: seen_at, b: entry_id}}) AS s FROM scan_entries e JOIN sync_runs r ON r.run_id = e.run_id AND r.run_no = {run_no} WHERE e.path IS NOT NULL GROUP BY ALL)"


def i2_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What the eighth run of every collection does to what the fifth listed."""
    return sync.sync_actions(listing(spark, sf, 8), listing(spark, sf, 5))


def i1_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return sync.orphans(listing(spark, sf, 5).select("collection_id", "path"), listing(spark, sf, 8))


def i3_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Append-only logs: run 8 against run 5 of the conversation collections."""

    def lines(run_no: int) -> DataFrame:
        runs = table(spark, sf, "sync_runs", "run_id", "run_no").filter(F.col("run_no") == run_no).select("run_id")
        kinds = table(spark, sf, "collections", "collection_id", "coll_type").filter("coll_type = 'conversation'").select("collection_id")
        rows = table(spark, sf, "scan_entries", "run_id", "collection_id", "path", "mtime", "line_count", "seen_at", "entry_id").join(runs, "run_id").join(kinds, "collection_id")
        newest = F.max_by(F.struct("mtime", "line_count"), F.struct("seen_at", "entry_id")).alias("s")
        return rows.filter("path IS NOT NULL").groupBy("collection_id", "path").agg(newest).select(F.concat_ws(":", "collection_id", "path").alias("path"), "s.mtime", "s.line_count")

    return sync.conversation_actions(lines(8), lines(5))


def _lines(run_no: int) -> str:
    return f"(SELECT concat_ws(':', e.collection_id, e.path) AS path, arg_max({{m: mtime, l: line_count}}, {{a: seen_at, b: entry_id}}) AS s FROM scan_entries e JOIN sync_runs r ON r.run_id = e.run_id AND r.run_no = {run_no} JOIN collections c ON c.collection_id = e.collection_id AND c.coll_type = 'conversation' WHERE e.path IS NOT NULL GROUP BY e.collection_id, e.path)"


def i4_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    return sync.watermark(listing(spark, sf, 5))


def i4_beyond(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf, 8).withColumnRenamed("mtime", "cursor").filter("cursor IS NOT NULL")
    return sync.beyond_watermark(rows, sync.watermark(listing(spark, sf, 5))).select("collection_id", "path", "fresh")


def i5_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Parser collections whose parser is no longer at the version they were indexed by, were every parser at version 2."""
    rows = table(spark, sf, "collections", "collection_id", "parser_name", "parser_version")
    return sync.needs_reindex(rows, rows.filter("parser_name IS NOT NULL").select("parser_name").distinct().withColumn("version", F.lit(2)))


def i6_failed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """After a scan that failed in part nothing is deleted."""
    return sync.sync_actions(listing(spark, sf, 8), listing(spark, sf, 5), failed=True).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def i8_code_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "path").filter("path IS NOT NULL")
    fields = sync.code_fields(F.col("path"), "work")
    return docs.select("doc_id", fields.alias("f")).select("doc_id", *[F.col("f")[n].alias(n) for n in ("lang", "ext", "filename", "rel_path")])


def talk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "messages", "session_id", "msg_id", "role", "content", "time_created", "ingested_at")
    newest = F.max_by(F.struct("session_id", "role", "content", "time_created"), F.struct("ingested_at", "session_id", "role", "content", "time_created")).alias("m")
    return rows.filter("msg_id IS NOT NULL AND session_id IS NOT NULL AND role IS NOT NULL").groupBy("msg_id").agg(newest).select("msg_id", "m.*")


def i10_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """The length, hash and number of messages of every session's transcript."""
    t = sync.transcript(talk(spark, sf), order=("time_created", "msg_id"))
    return t.select("session_id", F.sha2("transcript", 256).alias("hash"), F.length("transcript").cast("long").alias("n_chars"), "n_messages")


def i9_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = sync.transcript(talk(spark, sf), order=("time_created", "msg_id"))
    stated = table(spark, sf, "sessions", "session_id", "title").groupBy("session_id").agg(F.max("title").alias("title"))
    return t.join(stated, "session_id", "left").select("session_id", sync.session_title(F.col("title"), F.col("title_text"), F.col("session_id")).alias("title"))


def i11_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return sync.statistics(table(spark, sf, "documents", "doc_id", "collection_id"), table(spark, sf, "chunk_vectors", "chunk_id", "doc_id"), table(spark, sf, "collections"))


_ACTION = """CASE WHEN n.path IS NULL THEN '%s' WHEN n.s.content_hash IS NULL THEN 'skip' WHEN o.path IS NULL THEN 'insert'
 WHEN n.s.content_hash IS DISTINCT FROM o.s.content_hash THEN 'update' WHEN n.s.mtime IS DISTINCT FROM o.s.mtime THEN 'touch' ELSE 'skip' END"""
_TALK = """m AS (SELECT msg_id, arg_max({session_id: session_id, role: role, content: content, time_created: time_created}, {a: ingested_at, b: session_id, c: role, d: content, e: time_created}) AS m
 FROM messages WHERE msg_id IS NOT NULL AND session_id IS NOT NULL AND role IS NOT NULL GROUP BY msg_id)"""
SYNC = {
    "i1_orphans": (i1_orphans, f"SELECT o.collection_id, o.path FROM {_listing(5)} o ANTI JOIN {_listing(8)} n USING (collection_id, path)"),
    "i2_actions": (i2_actions, f"SELECT coalesce(n.collection_id, o.collection_id) AS collection_id, coalesce(n.path, o.path) AS path, {_ACTION % 'delete'} AS action FROM {_listing(8)} n FULL JOIN {_listing(5)} o ON n.collection_id = o.collection_id AND n.path = o.path"),
    "i3_conversations": (
        i3_conversations,
        f"SELECT n.path, a AS action, CASE WHEN a = 'append' THEN o.s.l ELSE 0 END::BIGINT AS from_line FROM (SELECT n.*, CASE WHEN o.s.m IS NULL THEN 'insert' WHEN o.s.m >= n.s.m THEN 'skip' WHEN o.s.l >= n.s.l THEN 'touch' ELSE 'append' END AS a FROM {_lines(8)} n LEFT JOIN {_lines(5)} o USING (path)) n LEFT JOIN {_lines(5)} o USING (path)",
    ),
    "i4_watermarks": (i4_watermarks, f"SELECT collection_id, max(s.mtime) AS since FROM {_listing(5)} GROUP BY 1"),
    "i4_beyond": (i4_beyond, f"SELECT n.collection_id, n.path, coalesce(w.since IS NULL OR n.s.mtime = 0 OR n.s.mtime > w.since, true) AS fresh FROM {_listing(8)} n LEFT JOIN (SELECT collection_id, max(s.mtime) AS since FROM {_listing(5)} GROUP BY 1) w USING (collection_id) WHERE n.s.mtime IS NOT NULL"),
    "i5_versions": (i5_versions, "SELECT collection_id FROM collections WHERE parser_name IS NOT NULL AND parser_version IS DISTINCT FROM 2"),
    "i6_failed_scan": (i6_failed_scan, f"SELECT {_ACTION % 'skip'} AS action, count(*) AS n FROM {_listing(8)} n FULL JOIN {_listing(5)} o ON n.collection_id = o.collection_id AND n.path = o.path GROUP BY 1"),
    "i8_code_fields": (
        i8_code_fields,
        f"SELECT doc_id, map_extract_value(MAP {{{', '.join(repr(e) + ': ' + repr(v) for e, v in languages.EXTENSIONS.items())}}}, lower(regexp_extract(path, '\\.([^./]+)$', 1))) AS lang, nullif(regexp_extract(split_part(path, '/', -1), '(\\.[^.]+)$', 1), '') AS ext, split_part(path, '/', -1) AS filename, CASE WHEN starts_with(path, 'work/') THEN substr(path, 6) ELSE path END AS rel_path FROM documents WHERE path IS NOT NULL",
    ),
    "i9_titles": (
        i9_titles,
        f"""WITH {_TALK}, u AS (SELECT m.session_id AS session_id, trim(arg_min(m.content, {{a: m.time_created, b: msg_id}}) FILTER (WHERE m.role = 'user' AND coalesce(m.content, '') <> ''), ' ') AS t FROM m GROUP BY 1),
 s AS (SELECT session_id, max(title) AS title FROM sessions GROUP BY 1)
 SELECT u.session_id, coalesce(nullif(trim(title, ' '), ''), nullif(CASE WHEN contains(t, chr(10)) AND length(split_part(t, chr(10), 1)) < 100 THEN split_part(t, chr(10), 1) WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END, ''), u.session_id) AS title FROM u LEFT JOIN s USING (session_id)""",
    ),
    "i10_transcripts": (
        i10_transcripts,
        f"""WITH {_TALK}, t AS (SELECT m.session_id AS session_id, string_agg('[' || m.role || ']: ' || coalesce(m.content, '') || chr(10) || chr(10), '' ORDER BY m.time_created NULLS FIRST, msg_id) AS x, count(*) AS n_messages FROM m GROUP BY 1)
 SELECT session_id, sha256(x) AS hash, length(x) AS n_chars, n_messages FROM t""",
    ),
    "i11_statistics": (
        i11_statistics,
        "SELECT collection_id, name, coalesce(n_docs, 0) AS n_docs, coalesce(n_chunks, 0) AS n_chunks FROM collections LEFT JOIN (SELECT collection_id, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY 1) USING (collection_id) LEFT JOIN (SELECT collection_id, count(DISTINCT chunk_id) AS n_chunks FROM chunk_vectors JOIN documents USING (doc_id) GROUP BY 1) USING (collection_id)",
    ),
}

# --- chunks, windows and texts ---------------------------------------------------------------------------------------------


def chunked(kind: str):
    """The number, size and lines of the chunks of every document."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        cut = chunks.chunk_documents(table(spark, sf, "documents", "doc_id", "text"), kind)
        return cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"), F.max("end_line").cast("long").alias("last_line"))

    return run


def w2_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's chunk 1 with a chunk before and after."""
    cut = chunks.chunk_documents(table(spark, sf, "documents", "doc_id", "text"), "conversation")
    found = chunks.with_context(cut.filter("seq = 1").select("doc_id", "seq"), cut, 1)
    return found.select("doc_id", F.length("context").cast("long").alias("n_chars"), "from_line", "to_line")


def w2_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every message of a session with the one before and the one after it, by the window form of the same."""
    by = Window.partitionBy("session_id").orderBy("time_created", "msg_id").rowsBetween(-1, 1)
    near = F.array_join(F.collect_list("msg_id").over(by), ",")
    return talk(spark, sf).filter("time_created IS NOT NULL").select("session_id", "msg_id", near.alias("around"))


def w5_first_chunk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunk_vectors", "doc_id", "seq", "chunk_id").filter("doc_id IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min_by("chunk_id", F.struct("seq", "chunk_id")).alias("chunk_id"))


def k12_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every document put together again from its chunks in order."""
    cut = chunks.chunk_documents(table(spark, sf, "documents", "doc_id", "text"), "conversation")
    whole = cut.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("text"))
    docs = table(spark, sf, "documents", "doc_id").join(whole, "doc_id", "left")
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def c5_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", sync.truncated(F.col("text")).alias("short"))


def c6_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", languages.line_count(F.col("text")).cast("long").alias("n_lines"))


def c8_extensions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_contents", "mime_type").groupBy(languages.media_extension(F.col("mime_type")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def c9_data_uris(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as data URIs and read back."""
    rows = table(spark, sf, "documents", "doc_id", "text").filter("text IS NOT NULL")
    back = languages.data_uri_parts(languages.data_uri(F.lit("text/plain"), F.col("text").cast("binary")))
    return rows.select("doc_id", back["media_type"].alias("media_type"), F.sha2(back["data"], 256).alias("hash"))


def c10_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "text").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


def s23_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """The cursors of sessions that are written in the format their collection states, in milliseconds."""
    rows = table(spark, sf, "sessions", "session_id", "cursor_format", "cursor_value")
    ms = F.floor(changes.cursor_micros(F.col("cursor_value"), F.col("cursor_format")) / 1000).cast("long")
    return rows.filter(F.col("cursor_format").isin("epoch_ms", "epoch_s") & F.col("cursor_value").rlike(r"^1\d{9}(\d{3})?$") & (F.length("cursor_value") == F.when(F.col("cursor_format") == "epoch_ms", 13).otherwise(10))).select("session_id", ms.alias("ms")).distinct()


TEXTS = {
    "c1_markdown_chunks": (chunked("markdown"), None),
    "c2_conversation_chunks": (chunked("conversation"), None),
    "c3_code_chunks": (chunked("code"), None),
    "c5_truncated": (c5_truncated, "SELECT doc_id, CASE WHEN contains(text, chr(10)) AND length(split_part(text, chr(10), 1)) < 100 THEN split_part(text, chr(10), 1) WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short FROM documents"),
    "c6_lines": (c6_lines, "SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines FROM documents"),
    "c8_extensions": (c8_extensions, "SELECT CASE lower(mime_type) WHEN 'image/png' THEN 'png' WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/jpg' THEN 'jpg' WHEN 'image/gif' THEN 'gif' WHEN 'image/webp' THEN 'webp' WHEN 'image/svg+xml' THEN 'svg' ELSE 'bin' END AS ext, count(*) AS n FROM file_contents GROUP BY 1"),
    "c9_data_uris": (c9_data_uris, "SELECT doc_id, 'text/plain' AS media_type, sha256(text) AS hash FROM documents WHERE text IS NOT NULL"),
    "c10_hashes": (c10_hashes, "SELECT sha256(text) AS hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1"),
    "k12_rebuilt": (k12_rebuilt, None),
    "s23_cursors": (s23_cursors, "SELECT DISTINCT session_id, cursor_value::BIGINT * CASE WHEN cursor_format = 'epoch_s' THEN 1000 ELSE 1 END AS ms FROM sessions WHERE (cursor_format = 'epoch_ms' AND regexp_matches(cursor_value, '^1\\d{12}$')) OR (cursor_format = 'epoch_s' AND regexp_matches(cursor_value, '^1\\d{9}$'))"),
    "w2_context": (w2_context, None),
    "w2_turns": (w2_turns, f"WITH {_TALK} SELECT m.session_id AS session_id, msg_id, string_agg(msg_id::VARCHAR, ',') OVER (PARTITION BY m.session_id ORDER BY m.time_created, msg_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM m WHERE m.time_created IS NOT NULL"),
    "w5_first_chunk": (w5_first_chunk, "SELECT doc_id, arg_min(chunk_id, {a: seq, b: chunk_id}) AS chunk_id FROM chunk_vectors WHERE doc_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1"),
}

_ALL = FACETS | FILTERS | SYNC | TEXTS
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLE = {k: s for k, (_, s) in _ALL.items() if s}
