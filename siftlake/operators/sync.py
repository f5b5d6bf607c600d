"""What a sync does to each document: insert, update, touch, skip or delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Collection types whose documents are not touched when only their time changed.
UNTOUCHED = ("image", "pdf")
TITLE_SIGNS = 100


def sync_actions(scan: DataFrame, store: DataFrame, coll_type: str = "code", failed: bool = False) -> DataFrame:
    """(collection_id, path, action) by full outer join of a scan and the store, both (collection_id, path, content_hash, mtime).

    Another hash updates; the same hash at another time touches (images and pages are skipped); what the scan lacks is
    deleted, unless the scan failed in part. A hash that is null is unreadable: such a file is left as it is.
    """
    new = scan.filter("path IS NOT NULL").groupBy("collection_id", "path").agg(F.max(F.struct("mtime", "content_hash")).alias("new"))
    old = store.filter("path IS NOT NULL").groupBy("collection_id", "path").agg(F.max(F.struct("mtime", "content_hash")).alias("old"))
    both = new.join(old, ["collection_id", "path"], "full_outer")
    unread = F.col("new").isNotNull() & F.col("new.content_hash").isNull()
    same = F.col("new.content_hash").eqNullSafe(F.col("old.content_hash"))
    action = (
        F.when(F.col("new").isNull(), "skip" if failed else "delete").when(unread, "skip").when(F.col("old").isNull(), "insert").when(~same, "update")
        .when(~F.col("new.mtime").eqNullSafe(F.col("old.mtime")), "skip" if coll_type in UNTOUCHED else "touch").otherwise("skip")
    )
    return both.select("collection_id", "path", action.alias("action"))


def conversation_actions(scan: DataFrame, store: DataFrame) -> DataFrame:
    """(path, action, from_line) for append-only logs, both sides (path, mtime, line_count).

    A file no newer than the store is skipped, one with no more lines touched, a new one read whole, else its lines from
    `from_line` on are appended.
    """
    s = store.select("path", F.col("mtime").alias("held_at"), F.col("line_count").alias("held"))
    both = scan.select("path", "mtime", "line_count").join(s, "path", "left")
    action = F.when(F.col("held_at").isNull(), "insert").when(F.col("held_at") >= F.col("mtime"), "skip").when(F.col("held") >= F.col("line_count"), "touch").otherwise("append")
    return both.select("path", action.alias("action"), F.when(action == "append", F.col("held")).otherwise(0).cast("long").alias("from_line"))


def watermark(store: DataFrame, cursor: str = "mtime") -> DataFrame:
    """(collection_id, since): the latest cursor that each collection holds."""
    return store.groupBy("collection_id").agg(F.max(cursor).alias("since"))


def beyond_watermark(sessions: DataFrame, marks: DataFrame, cursor: str = "cursor") -> DataFrame:
    """`sessions` with `fresh`: whether the cursor lies beyond the collection's mark, is 0, or the collection is new.

    The others come along so that they are not taken for deleted.
    """
    joined = sessions.join(marks, "collection_id", "left")
    fresh = F.col("since").isNull() | (F.col(cursor) == 0) | (F.col(cursor) > F.col("since"))
    return joined.withColumn("fresh", F.coalesce(fresh, F.lit(True))).drop("since")


def orphans(store: DataFrame, scan: DataFrame) -> DataFrame:
    """Stored documents whose path is in no scan of their collection."""
    return store.join(scan.select("collection_id", "path").distinct(), ["collection_id", "path"], "left_anti")


def needs_reindex(collections: DataFrame, versions: DataFrame) -> DataFrame:
    """(collection_id) whose parser has another version than it was indexed by: all of it is dropped and read anew."""
    v = versions.select("parser_name", F.col("version").alias("now"))
    return collections.join(v, "parser_name").filter(~F.col("parser_version").eqNullSafe(F.col("now"))).select("collection_id")


def truncated(text: Column, signs: int = TITLE_SIGNS) -> Column:
    """The first line if it ends before `signs` signs, else so many signs and three dots."""
    line = F.substring_index(text, "\n", 1)
    return F.when((F.length(line) < F.length(text)) & (F.length(line) < signs), line).when(F.length(text) > signs, F.concat(F.substring(text, 1, signs), F.lit("..."))).otherwise(text)


def transcript(messages: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(session, transcript, title_text, n_messages): every message as [role]: content and a blank line, in order, and the first user text.

    A transcript is one document by definition and as large as its session.
    """
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.coalesce(F.col("content"), F.lit("")), F.lit("\n\n"))
    parts = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when((F.col("role") == "user") & (F.coalesce(F.col("content"), F.lit("")) != ""), F.struct(*order)))
    return messages.groupBy(session).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("transcript"), first.alias("title_text"), F.count(F.lit(1)).alias("n_messages"))


def session_title(stated: Column, first_user_text: Column, session: Column) -> Column:
    """The stated title, else the first user message cut to 100 signs, else the session id."""
    return F.coalesce(F.nullif(F.trim(stated), F.lit("")), F.nullif(truncated(F.trim(first_user_text)), F.lit("")), session)


def code_fields(path: Column, root: str = "") -> Column:
    """Fast fields of a source file: lang, ext, filename and rel_path; empty ones are left out."""
    from siftlake.functions.languages import language_of

    name = F.substring_index(path, "/", -1)
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    rel = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path) if root else path
    fields = F.create_map(F.lit("lang"), F.coalesce(language_of(path), F.lit("")), F.lit("ext"), ext, F.lit("filename"), name, F.lit("rel_path"), rel)
    return F.map_filter(fields, lambda _, v: v != "")


def session_fields(workspace: Column, parent: Column) -> Column:
    """Fast fields of a session; empty ones are left out."""
    return F.map_filter(F.create_map(F.lit("workspace"), F.coalesce(workspace, F.lit("")), F.lit("parent"), F.coalesce(parent, F.lit(""))), lambda _, v: v != "")


def statistics(docs: DataFrame, chunks: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection_id, name, n_docs, n_chunks) of every collection, empty ones included."""
    d = docs.groupBy("collection_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    c = chunks.join(docs.select("doc_id", "collection_id").distinct(), "doc_id").groupBy("collection_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    out = collections.select("collection_id", "name").join(d, "collection_id", "left").join(c, "collection_id", "left")
    return out.select("collection_id", "name", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def last_text_before(blocks: DataFrame, session: str = "session_id", order: str = "seq", signs: int = 500) -> DataFrame:
    """`blocks` with `context`: the last text up to each block, cut to `signs` signs. What an image stands beside."""
    by = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("context", F.substring(F.last(F.nullif(F.col("text"), F.lit("")), ignorenulls=True).over(by), 1, signs))
