"""Declared sources: what a chat program's files or databases hold is said in a schema, and read by one engine.

A schema lists sources; the first whose conditions hold is taken, and of it the first version that fits. Log sources are
JSON lines read by Spark; database sources run the declared SELECTs on SQLite files, read-only, on the executors.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.operators.changes import cursor_micros

DRIVERS = ("sqlite", "jsonl", "jsonfiles")
CURSOR_FORMATS = ("epoch_ms", "epoch_s", "rfc3339", "datetime")
METADATA = ("workspace", "parent")


class SchemaError(ValueError):
    """A schema that cannot be used as it is written."""


@dataclass(frozen=True)
class Sessions:
    query: str = ""
    id: str = ""
    title: str = ""
    cursor: str = ""
    cursor_format: str = "epoch_s"
    data: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    id_from_filename: bool = False
    cursor_from_mtime: bool = False


@dataclass(frozen=True)
class Messages:
    query: str = ""
    role: str = ""
    content: str = ""
    inline: bool = False
    decode: str = ""
    items: str = ""
    variants: list[dict] = field(default_factory=list)
    line_filter: list[str] = field(default_factory=list)
    role_field: str = ""
    content_path: str = ""
    content_path_user: str = ""
    text_types: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Version:
    version: int
    sessions: Sessions
    messages: Messages
    when: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    driver: str
    paths: list[str]
    versions: list[Version]
    when: dict = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Schema:
    name: str
    sources: list[Source]
    description: str = ""
    format: int = 1


# fixed values: where known programs keep their sessions, and how these are written
BUILT_IN = """
- {format: 1, name: claude, description: "JSON lines, one file per session", sources: [{driver: jsonl, when: {dir_exists: "~/.claude/projects"}, paths: ["~/.claude/projects"], versions: [{version: 1,
    sessions: {id_from_filename: true, cursor_from_mtime: true, cursor_format: epoch_s, metadata: {workspace: cwd}},
    messages: {line_filter: [user, assistant], role_field: type, content_path: "message.content,message", content_path_user: "message.content,message", text_types: [text]}}]}]}
- {format: 1, name: codex, description: "JSON lines with a line of metadata", sources: [{driver: jsonl, when: {dir_exists: "~/.codex/sessions"}, paths: ["~/.codex/sessions", "~/.codex/archived_sessions"], exclude: [session_index.jsonl], versions: [{version: 1,
    sessions: {id: payload.id, cursor_from_mtime: true, cursor_format: epoch_s},
    messages: {line_filter: [response_item], role_field: payload.role, content_path: payload.content, text_types: [input_text, output_text]}}]}]}
- {format: 1, name: opencode, description: "SQLite, a database per workspace", sources: [{driver: sqlite, when: {file_exists: "~/.local/share/opencode/opencode.db"}, paths: ["~/.local/share/opencode/opencode*.db"], exclude: ["*-wal", "*-shm"], versions: [{version: 1,
    sessions: {query: "SELECT id, title, directory, parent_id, time_updated FROM session", id: id, title: title, cursor: time_updated, cursor_format: epoch_ms, metadata: {workspace: directory, parent: parent_id}},
    messages: {query: "SELECT m.session_id AS session_id, json_extract(m.data,'$.role') AS role, coalesce(json_extract(p.data,'$.text'), json_extract(p.data,'$.state.output')) AS content FROM message m JOIN part p ON p.message_id = m.id WHERE json_extract(p.data,'$.type') IN ('text','tool') ORDER BY m.session_id, m.time_created, p.time_created", role: role, content: content}}]}]}
- {format: 1, name: copilot-cli, description: "SQLite, a row per turn", sources: [{driver: sqlite, when: {file_exists: "~/.copilot/session-store.db"}, paths: ["~/.copilot/session-store.db"], versions: [{version: 1,
    sessions: {query: "SELECT id, summary, cwd, updated_at FROM sessions", id: id, title: summary, cursor: updated_at, cursor_format: rfc3339, metadata: {workspace: cwd}},
    messages: {query: "SELECT session_id, turn_index, 1 AS half, 'user' AS role, user_message AS content FROM turns UNION ALL SELECT session_id, turn_index, 2, 'assistant', assistant_response FROM turns ORDER BY session_id, turn_index, half", role: role, content: content}}]}]}
- {format: 1, name: zed, description: "SQLite with compressed JSON", sources: [{driver: sqlite, when: {file_exists: "~/.local/share/zed/threads/threads.db"}, paths: ["~/.local/share/zed/threads/threads.db"], versions: [{version: 1,
    sessions: {query: "SELECT id, summary, updated_at, data, folder_paths, parent_id FROM threads", id: id, title: summary, cursor: updated_at, cursor_format: rfc3339, data: data, metadata: {workspace: folder_paths, parent: parent_id}},
    messages: {inline: true, decode: zstd, items: messages, variants: [{match_key: User, role: user, array_field: content, text_keys: [Text]}, {match_key: Agent, role: assistant, array_field: content, text_keys: [Text, Thinking.text]}]}}]}]}
"""


def _only(cls, given: dict, what: str):
    """A dataclass from a mapping; a field it does not have is an error."""
    unknown = set(given) - set(cls.__dataclass_fields__)
    if unknown:
        raise SchemaError(f"{what} has no {sorted(unknown)[0]}")
    return cls(**given)


def from_mapping(given: dict) -> Schema:
    """A schema from what a YAML file holds; checked."""
    if not isinstance(given, dict):
        raise SchemaError("a schema is a mapping")
    sources = []
    for s in given.get("sources") or []:
        versions = [_only(Version, {**v, "sessions": _only(Sessions, v.get("sessions") or {}, "sessions"), "messages": _only(Messages, v.get("messages") or {}, "messages")}, "a version") for v in s.get("versions") or []]
        sources.append(_only(Source, {**s, "versions": versions}, "a source"))
    return check(_only(Schema, {**given, "sources": sources}, "a schema"))


def check(schema: Schema) -> Schema:
    """The schema itself, if it can be used."""

    def demand(ok: object, text: str) -> None:
        if not ok:
            raise SchemaError(f"{schema.name}: {text}")

    demand(schema.name and not re.search(r"[/\\]|\.\.", schema.name), "a name has no slash and no ..")
    demand(schema.format == 1, "the format is not 1")
    demand(schema.sources, "there is no source")
    for s in schema.sources:
        demand(s.driver in DRIVERS, f"there is no driver {s.driver}")
        demand(s.paths and s.versions, "a source needs paths and versions")
        demand(set(s.when) <= {"file_exists", "dir_exists", "table_exists", "column_exists"}, "a condition is not known")
        for v in s.versions:
            demand(v.sessions.cursor_format in CURSOR_FORMATS, f"there is no cursor format {v.sessions.cursor_format}")
            demand(set(v.sessions.metadata) <= set(METADATA), "metadata is workspace or parent")
            for query in (v.sessions.query, v.messages.query):
                demand(not query or re.match(r"(?is)^\s*(select|with)\b", query) and ";" not in query.rstrip().rstrip(";"), "a query is one SELECT")
            if s.driver == "sqlite":
                demand(v.sessions.query and v.sessions.id, "a database needs a sessions query and its id")
                demand(bool(v.messages.query) != v.messages.inline, "messages are either queried or inline")
                demand(not v.messages.inline or v.sessions.data and v.messages.variants, "inline messages need a data column and variants")
                demand(v.messages.decode in ("", "zstd"), f"there is no decoding {v.messages.decode}")
            else:
                demand(v.messages.role_field and v.messages.content_path, "log lines need a role field and a content path")
                demand(v.sessions.id_from_filename != bool(v.sessions.id), "the session id is either in the name or in a line")
    return schema


def _parsed(text: str):
    import yaml  # only schemas and settings need it

    return yaml.safe_load(text)


def built_in() -> dict[str, Schema]:
    return {s["name"]: from_mapping(s) for s in _parsed(BUILT_IN)}


def load(name: str, folder: str | None = None) -> Schema:
    """A schema by name; one in the user's folder stands before the built-in one."""
    if re.search(r"[/\\]|\.\.", name):
        raise SchemaError("a name has no slash and no ..")
    if folder and os.path.exists(at := os.path.join(folder, f"{name}.yaml")):
        with open(at, encoding="utf-8") as f:
            return from_mapping(_parsed(f.read()))
    known = built_in()
    if name not in known:
        raise SchemaError(f"there is no schema {name}")
    return known[name]


def listed(folder: str | None = None) -> list[str]:
    own = [os.path.splitext(os.path.basename(p))[0] for p in glob.glob(os.path.join(folder, "*.yaml"))] if folder else []
    return sorted(set(own) | set(built_in()))


# --- which source -----------------------------------------------------------------------------------------------------------


def expanded(paths: list[str], exclude: list[str] = ()) -> list[str]:
    """Existing files and folders for patterns, ~ resolved; what an exclusion matches, by name or whole, is left out."""
    import fnmatch

    found = sorted({p for pattern in paths for p in glob.glob(os.path.expanduser(pattern))})
    return [p for p in found if not any(fnmatch.fnmatch(os.path.basename(p), x) or fnmatch.fnmatch(p, os.path.expanduser(x)) for x in exclude)]


def _holds(when: dict, database: str | None) -> bool:
    if "file_exists" in when and not os.path.isfile(os.path.expanduser(when["file_exists"])):
        return False
    if "dir_exists" in when and not os.path.isdir(os.path.expanduser(when["dir_exists"])):
        return False
    if "table_exists" in when or "column_exists" in when:
        if database is None:
            return False
        with sqlite3.connect(f"file:{database}?mode=ro", uri=True) as db:
            table, column = when.get("column_exists", (when.get("table_exists"), None))
            columns = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]
            return column in columns if column else bool(columns)
    return True


def detect(schema: Schema) -> tuple[Source, Version, list[str]] | None:
    """The first source and version that fit, with their paths; None if none does. Every source is tried, whatever its driver."""
    for source in schema.sources:
        if not _holds({k: v for k, v in source.when.items() if k.endswith("_exists") and k[:4] in ("file", "dir_")}, None):
            continue
        paths = expanded(source.paths, source.exclude)
        if not paths:
            continue
        database = paths[0] if source.driver == "sqlite" else None
        if not _holds({k: v for k, v in source.when.items() if k in ("table_exists", "column_exists")}, database):
            continue
        for version in source.versions:
            if _holds(version.when, database):
                return source, version, paths
    return None


# --- JSON lines -------------------------------------------------------------------------------------------------------------

_BLOCKS = "array<struct<type:string,text:string>>"


def json_at(line: Column, path: str) -> Column:
    """What stands at a dotted path of a JSON text: a string as it is, other values as JSON; null if nothing does."""
    return F.get_json_object(line, "$." + ".".join(path.split(".")))


def block_text(value: Column, types: list[str]) -> Column:
    """The text of a content value: a string itself, or the text blocks of an array, one per line; empty text is null."""
    blocks = F.from_json(value, _BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin(*types) & b["text"].isNotNull()), lambda b: b["text"])
    joined = F.when(value.startswith("["), F.array_join(texts, "\n")).when(~value.startswith("{"), value)
    return F.nullif(F.trim(joined), F.lit(""))


def log_lines(spark: SparkSession, paths: list[str], exclude: list[str] = ()) -> DataFrame:
    """(path, name, mtime, line_no, line) of the JSON lines files below some folders; line_no counts from 1.

    A file is numbered within one task. Lines that are no JSON object come along; readers pass them over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(paths)
    name = F.substring_index("path", "/", -1)
    kept = files.filter(~name.isin(*exclude)) if exclude else files
    text = F.split(F.decode("content", "utf-8"), "\r?\n")
    each = kept.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), name.alias("name"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.posexplode(text).alias("n", "line"))
    return each.select("path", "name", "mtime", (F.col("n") + 1).alias("line_no"), "line").filter(F.trim("line") != "")


def read_log(lines: DataFrame, version: Version, from_line: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sessions (session_id, src_path, title, cursor_ms, workspace, parent, n_lines) and messages (session_id, seq, role, content) of log lines.

    Only lines of the listed types and with role user or assistant are messages; broken lines and those without text are
    passed over. `from_line` (path, from_line) leaves out the lines read before.
    """
    s, m = version.sessions, version.messages
    line = F.col("line")
    typed = lines.withColumn("type", json_at(line, "type"))
    spoken = typed.filter(F.col("type").isin(*m.line_filter)) if m.line_filter else typed
    role = json_at(line, m.role_field)
    paths = lambda p: F.coalesce(*[block_text(json_at(line, x.strip()), m.text_types) for x in p.split(",")])
    content = F.when(role == "user", paths(m.content_path_user or m.content_path)).otherwise(paths(m.content_path))
    stem = F.regexp_replace(F.col("name"), r"\.jsonl$", "")
    if s.id_from_filename:
        ids = lines.groupBy("path").agg(F.first("name").alias("name"), F.max("mtime").alias("mtime"), F.max("line_no").alias("n_lines")).withColumn("session_id", stem)
    else:
        # the id stands in a line that is no message; a file without one is called by its name
        meta = typed.filter(~F.col("type").isin(*m.line_filter)).select("path", "line_no", json_at(line, s.id).alias("id")).filter("id IS NOT NULL").groupBy("path").agg(F.min_by("id", "line_no").alias("id"))
        ids = lines.groupBy("path").agg(F.first("name").alias("name"), F.max("mtime").alias("mtime"), F.max("line_no").alias("n_lines")).join(meta, "path", "left").withColumn("session_id", F.coalesce("id", stem))
    chosen = spoken.select("path", "line_no", "line", role.alias("role"), content.alias("content")).filter(F.col("role").isin("user", "assistant") & F.col("content").isNotNull())
    extra = {k: F.nullif(json_at(F.col("line"), p), F.lit("")) for k, p in s.metadata.items()}
    firsts = chosen.groupBy("path").agg(*[F.min_by(extra.get(k, F.lit(None).cast("string")), F.when(extra[k].isNotNull(), F.col("line_no")) if k in extra else F.lit(1)).alias(k) for k in METADATA])
    sessions = ids.join(firsts, "path", "left").select("session_id", F.col("path").alias("src_path"), F.lit(None).cast("string").alias("title"), F.floor(F.col("mtime") * 1000).alias("cursor_ms"), *METADATA, "n_lines")
    kept = chosen if from_line is None else chosen.join(from_line, "path", "left").filter(F.col("line_no") > F.coalesce("from_line", F.lit(0)))
    by = Window.partitionBy("path").orderBy("line_no")
    messages = kept.join(ids.select("path", "session_id"), "path").select("session_id", (F.row_number().over(by) - 1).alias("seq"), "role", "content")
    return sessions, messages


def thread_names(lines: DataFrame) -> DataFrame:
    """(session_id, thread_name) of the lines of an index file, the last one counting."""
    named = lines.select("line_no", json_at(F.col("line"), "id").alias("session_id"), json_at(F.col("line"), "thread_name").alias("thread_name"))
    return named.filter("session_id IS NOT NULL AND thread_name IS NOT NULL").groupBy("session_id").agg(F.max_by("thread_name", "line_no").alias("thread_name"))


def block_images(lines: DataFrame, role_path: str = "type", content_path: str = "message.content") -> DataFrame:
    """(path, line_no, n, media_type, data, context) of the images that message blocks hold as base64 or data URIs.

    context is the last text of the log up to the image, 500 signs at most; `n` numbers the images of a file from 1.
    """
    from siftlake.functions.languages import data_uri_parts

    blocks = F.from_json(json_at(F.col("line"), content_path), "array<struct<type:string,text:string,image_url:string,source:struct<type:string,media_type:string,data:string>>>")
    each = lines.select("path", "line_no", F.posexplode(blocks).alias("at", "b"))
    uri = F.when(F.col("b.source.data").isNotNull(), F.concat(F.lit("data:"), F.coalesce("b.source.media_type", F.lit("image/png")), F.lit(";base64,"), F.col("b.source.data"))).otherwise(F.col("b.image_url"))
    parts = each.select("path", "line_no", "at", F.nullif(F.col("b.text"), F.lit("")).alias("text"), data_uri_parts(uri).alias("image"))
    before = Window.partitionBy("path").orderBy("line_no", "at").rowsBetween(Window.unboundedPreceding, 0)
    seen = parts.withColumn("context", F.substring(F.last("text", ignorenulls=True).over(before), 1, 500)).filter("image.data IS NOT NULL")
    return seen.select("path", "line_no", F.row_number().over(Window.partitionBy("path").orderBy("line_no", "at")).alias("n"), "image.media_type", "image.data", "context")


# --- databases --------------------------------------------------------------------------------------------------------------


def query_databases(spark: SparkSession, paths: list[str], query: str, columns: list[str], binary: tuple[str, ...] = ()) -> DataFrame:
    """(src_path, row_no, columns as text) of a SELECT on each of some SQLite files, read-only, a file per task.

    A column that the result does not have is an error. Files must be visible to the executors.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    cursor = db.execute(query)
                    names = [d[0] for d in cursor.description]
                    missing = [c for c in columns if c not in names]
                    if missing:
                        raise SchemaError(f"the query gives no column {missing[0]}")
                    at = [names.index(c) for c in columns]
                    number = 0
                    while rows := cursor.fetchmany(5000):
                        out = [pa.array([path] * len(rows), pa.string()), pa.array(range(number, number + len(rows)), pa.int64())]
                        for c, i in zip(columns, at, strict=True):
                            values = [r[i] for r in rows]
                            if c in binary:
                                out.append(pa.array([v.encode() if isinstance(v, str) else v for v in values], pa.binary()))
                            else:
                                out.append(pa.array([None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in values], pa.string()))
                        yield pa.RecordBatch.from_arrays(out, ["src_path", "row_no", *columns])
                        number += len(rows)

    kinds = ", ".join(["src_path string", "row_no long", *[f"`{c}` {'binary' if c in binary else 'string'}" for c in columns]])
    each = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return each.mapInArrow(run, kinds)


def decoded(data: Column, decode: str) -> Column:
    """The JSON text of a blob, decompressed if it says so; null if it cannot be."""
    if not decode:
        return F.decode(data, "utf-8")

    @F.arrow_udf("string")
    def run(blobs):
        import pyarrow as pa
        import zstandard

        def text(b):
            try:
                return zstandard.ZstdDecompressor().stream_reader(b).read().decode("utf-8", "replace")
            except zstandard.ZstdError:
                return None

        return pa.array([None if b is None else text(b) for b in blobs.to_pylist()], pa.string())

    return run(data)


def inline_messages(sessions: DataFrame, m: Messages) -> DataFrame:
    """(session_id, seq, role, content) of sessions (session_id, json): items at a path, each read by the first variant whose key it has."""
    items = F.from_json(F.get_json_object("json", f"$.{m.items}"), "array<string>")
    each = sessions.select("session_id", F.posexplode(items).alias("seq", "item"))
    role = content = None
    for v in m.variants:
        inner = F.get_json_object("item", f"$.{v['match_key']}")
        parts = F.from_json(F.get_json_object("item", f"$.{v['match_key']}.{v['array_field']}"), "array<string>")
        text = lambda p, v=v: F.coalesce(*[F.get_json_object(p, f"$.{k}") for k in v["text_keys"]])

        def texts(p, text=text):
            return text(p)

        joined = F.array_join(F.filter(F.transform(parts, lambda p: texts(p)), lambda t: t.isNotNull() & (t != "")), "\n")
        role = F.when(inner.isNotNull(), v["role"]) if role is None else role.when(inner.isNotNull(), v["role"])
        content = F.when(inner.isNotNull(), joined) if content is None else content.when(inner.isNotNull(), joined)
    return each.select("session_id", "seq", role.alias("role"), content.alias("content")).filter("role IS NOT NULL AND content <> ''")


def read_databases(spark: SparkSession, version: Version, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages of SQLite files, as `read_log` gives them. Messages of all sessions are read by one query and joined."""
    s, m = version.sessions, version.messages
    wanted = [c for c in dict.fromkeys([s.id, s.title, s.cursor, *s.metadata.values(), s.data]) if c]
    rows = query_databases(spark, paths, s.query, wanted, (s.data,) if s.data else ())
    ms = F.floor(cursor_micros(F.col(s.cursor), F.lit(s.cursor_format)) / 1000).cast("long") if s.cursor else F.lit(None).cast("long")
    named = {k: F.col(s.metadata[k]) if k in s.metadata else F.lit(None).cast("string") for k in METADATA}
    sessions = rows.select(F.col(s.id).alias("session_id"), F.concat_ws("#", "src_path", s.id).alias("src_path"), (F.col(s.title) if s.title else F.lit(None).cast("string")).alias("title"), ms.alias("cursor_ms"), *[c.alias(k) for k, c in named.items()], F.lit(None).cast("int").alias("n_lines"))
    if m.inline:
        return sessions, inline_messages(rows.select(F.col(s.id).alias("session_id"), decoded(F.col(s.data), m.decode).alias("json")), m)
    spoken = query_databases(spark, paths, m.query, ["session_id", m.role, m.content])
    by = Window.partitionBy("src_path", "session_id").orderBy("row_no")
    messages = spoken.filter(F.coalesce(F.col(m.content), F.lit("")) != "").select("session_id", (F.row_number().over(by) - 1).alias("seq"), F.col(m.role).alias("role"), F.col(m.content).alias("content"))
    return sessions, messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def read_source(spark: SparkSession, schema: Schema) -> tuple[DataFrame, DataFrame] | None:
    """Sessions and messages of the source of a schema that is present; None if none is."""
    found = detect(schema)
    if found is None:
        return None
    source, version, paths = found
    return read_databases(spark, version, paths) if source.driver == "sqlite" else read_log(log_lines(spark, paths, source.exclude), version)
