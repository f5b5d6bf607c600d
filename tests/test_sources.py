import base64
import io
import json
import os
import sqlite3
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from siftlake.functions import languages
from siftlake.sources import extract, files, schemas


def put(root, name, data):
    at = os.path.join(root, name)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def scanned(spark, root, kind, pattern=""):
    return {r.rel_path: r for r in files.scan(spark, str(root), kind, pattern).collect()}


def test_markdown_scan(spark, tmp_path):
    put(tmp_path, "a.md", "intro\n# Title A \nmore\n# Second")
    put(tmp_path, "sub/b.markdown", "no heading\n")
    put(tmp_path, "c.txt", "# no")
    put(tmp_path, "empty.md", "")
    put(tmp_path, "late.md", "x\n" * 25 + "# Late")
    got = scanned(spark, tmp_path, "markdown")
    assert {k: (r.title, r.line_count) for k, r in got.items()} == {"a.md": ("Title A", 4), "sub/b.markdown": ("b", 2), "empty.md": ("empty", 1), "late.md": ("late", 26)}
    assert got["a.md"].content_hash == __import__("hashlib").sha256(b"intro\n# Title A \nmore\n# Second").hexdigest() and got["a.md"].mtime > 1e9
    assert set(scanned(spark, tmp_path, "markdown", "c*")) == {"c.txt"}
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "nosuch"), "markdown")


def test_code_scan(spark, tmp_path):
    for name, data in {"main.go": "package a", "pkg/utils/util.py": "x = 1\ny = 2", "node_modules/x.js": "1", "src/.hidden/x.py": "1", "package-lock.json": "{}", "bin.py": b"a\x00b", "zero.py": b"\x10\x01", "app.min.js": "1", "ignored_dir/a.ts": "1", "deep/ignored_dir/b.ts": "1", "b.temp.ts": "1", "index.ts": "let a", "notes.xyz": "1"}.items():
        put(tmp_path, name, data)
    put(tmp_path, ".gitignore", "# comment\n\nignored_dir/\n*.temp.ts\n")
    got = scanned(spark, tmp_path, "code")
    assert set(got) == {"main.go", "pkg/utils/util.py", "index.ts", "zero.py", "deep/ignored_dir/b.ts"} and got["pkg/utils/util.py"].title == "pkg/utils/util.py"
    assert set(scanned(spark, tmp_path, "code", "*.py")) == {"pkg/utils/util.py", "zero.py"}
    df = spark.createDataFrame([(p,) for p in ("a/B.PY", "x.h", "x", "y.mjs", "z.zsh")], "p string")
    assert [r[0] for r in df.select(languages.language_of(F.col("p"))).collect()] == ["python", "c", None, "javascript", "shell"] and len(languages.LANGUAGES) == 44 and len(languages.EXTENSIONS) == 69


def test_other_scans_and_images(spark, tmp_path):
    for name in ("a.PNG", "b.svg", "c.pdf", "d.docx", "e.html", "f.go"):
        put(tmp_path, name, b"x")
    assert {k: set(scanned(spark, tmp_path, k)) for k in ("image", "pdf", "document")} == {"image": {"a.PNG", "b.svg"}, "pdf": {"c.pdf"}, "document": {"d.docx", "e.html"}}
    rows = files.save_images(spark.createDataFrame([("i.png", bytearray(b"1")), ("../j.png", None)], "name string, data binary"), str(tmp_path / "out")).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["i.png", "j.png"] and all(os.path.exists(r.path) for r in rows)


def test_media_and_data_uris(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(languages.media_extension(F.lit("IMAGE/JPEG"))) == "jpg" and one(languages.media_extension(F.lit(None).cast("string"))) == "bin" and one(languages.media_type_of(F.lit("a.b/c.webp"))) == "image/webp" and one(languages.media_type_of(F.lit("c"))) == "image/png"
    for uri, want in (("data:image/png;base64,aGk=", b"hi"), ("data:image/png;base64,aGk", b"hi"), ("data:;base64,", b"")):
        assert bytes(one(languages.data_uri_parts(F.lit(uri)))["data"]) == want
    assert one(languages.data_uri_parts(F.lit("http://x"))) is None


def lines(*objects):
    return "\n".join(x if isinstance(x, str) else json.dumps(x) for x in objects) + "\n"


def test_log_of_wrapped_messages(spark, tmp_path):
    png = base64.b64encode(b"img").decode()
    put(tmp_path, "proj/s1.jsonl", lines(
        {"type": "summary", "cwd": "/no"}, {"type": "user", "message": {"role": "user", "content": "hi"}, "cwd": ""}, "{broken", {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}, "cwd": "/w"},
        {"type": "user", "message": {"content": [{"type": "tool_result"}]}}, {"type": "system", "message": {"content": "no"}}, {"type": "assistant", "message": "old style"},
        {"type": "user", "message": {"content": [{"type": "text", "text": "see"}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": png}}]}},
    ))
    version = schemas.load("claude").sources[0].versions[0]
    rows = schemas.log_lines(spark, [str(tmp_path)])
    sessions, messages = schemas.read_log(rows, version)
    s = sessions.first()
    assert (s.session_id, s.workspace, s.n_lines) == ("s1", "/w", 8) and s.cursor_ms > 1e12
    assert [(m.seq, m.role, m.content) for m in messages.orderBy("seq").collect()] == [(0, "user", "hi"), (1, "assistant", "a\nb"), (2, "assistant", "old style"), (3, "user", "see")]
    later = spark.createDataFrame([(s.src_path, 6)], "path string, from_line int")
    assert [m.content for m in schemas.read_log(rows, version, later)[1].collect()] == ["old style", "see"]
    i = schemas.block_images(rows).first()
    assert (bytes(i.data), i.media_type, i.context, i.n) == (b"img", "image/png", "see", 1)


def test_log_with_a_metadata_line(spark, tmp_path):
    put(tmp_path, "2024/r.jsonl", lines({"type": "session_meta", "payload": {"id": "abc"}}, {"type": "response_item", "payload": {"role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"type": "response_item", "payload": {"role": "system", "content": [{"type": "input_text", "text": "no"}]}}, {"type": "response_item", "payload": {"role": "assistant", "content": [{"type": "output_text", "text": "a"}, {"type": "reasoning", "text": "no"}]}}))
    put(tmp_path, "session_index.jsonl", lines({"id": "abc", "thread_name": "old"}, {"id": "abc", "thread_name": "Talk"}, "x"))
    source = schemas.load("codex").sources[0]
    sessions, messages = schemas.read_log(schemas.log_lines(spark, [str(tmp_path)], source.exclude), source.versions[0])
    assert [(m.session_id, m.role, m.content) for m in messages.orderBy("seq").collect()] == [("abc", "user", "q"), ("abc", "assistant", "a")] and sessions.count() == 1
    names = schemas.thread_names(schemas.log_lines(spark, [str(tmp_path)]).filter("name = 'session_index.jsonl'"))
    assert [(r.session_id, r.thread_name) for r in names.collect()] == [("abc", "Talk")]


def db(path, *statements):
    with sqlite3.connect(path) as c:
        for sql, *rows in statements:
            c.executemany(sql, rows) if rows else c.execute(sql)


def test_databases(spark, tmp_path):
    a = str(tmp_path / "a.db")
    db(a, ("CREATE TABLE session (id, title, directory, parent_id, time_updated)",), ("CREATE TABLE message (id, session_id, time_created, data)",), ("CREATE TABLE part (id, message_id, time_created, data)",),
       ("INSERT INTO session VALUES (?,?,?,?,?)", ("s1", "T", "/w", None, 1786216319613)), ("INSERT INTO message VALUES (?,?,?,?)", ("m1", "s1", 1, '{"role":"user"}'), ("m2", "s1", 2, '{"role":"assistant"}')),
       ("INSERT INTO part VALUES (?,?,?,?)", ("p2", "m2", 2, '{"type":"tool","state":{"output":"out"}}'), ("p1", "m1", 1, '{"type":"text","text":"q"}'), ("p3", "m2", 3, '{"type":"step"}')))
    sessions, messages = schemas.read_databases(spark, schemas.load("opencode").sources[0].versions[0], [a])
    s = sessions.first()
    assert (s.session_id, s.title, s.cursor_ms, s.workspace, s.parent, s.src_path) == ("s1", "T", 1786216319613, "/w", None, f"{a}#s1")
    assert [(m.role, m.content) for m in messages.orderBy("seq").collect()] == [("user", "q"), ("assistant", "out")]
    b = str(tmp_path / "b.db")
    db(b, ("CREATE TABLE sessions (id, summary, cwd, updated_at)",), ("CREATE TABLE turns (session_id, turn_index, user_message, assistant_response)",), ("INSERT INTO sessions VALUES (?,?,?,?)", ("x", "S", "/c", "2026-01-02T03:04:05Z")), ("INSERT INTO turns VALUES (?,?,?,?)", ("x", 1, "u1", "a1"), ("x", 0, "u0", None)))
    sessions, messages = schemas.read_databases(spark, schemas.load("copilot-cli").sources[0].versions[0], [b])
    assert [(m.role, m.content) for m in messages.orderBy("seq").collect()] == [("user", "u0"), ("user", "u1"), ("assistant", "a1")] and sessions.first().cursor_ms == 1767323045000
    blob = zstandard.ZstdCompressor().compress(json.dumps({"messages": [{"User": {"content": [{"Text": "hi"}, {"Mention": {}}]}}, {"Agent": {"content": [{"Thinking": {"text": "hm"}}, {"Text": "ok"}, {"ToolUse": {}}]}}, {"Other": {}}]}).encode())
    c = str(tmp_path / "c.db")
    db(c, ("CREATE TABLE threads (id, summary, updated_at, data, folder_paths, parent_id)",), ("INSERT INTO threads VALUES (?,?,?,?,?,?)", ("z", "Z", "2026-01-02T03:04:05Z", blob, "/z", "p"), ("bad", "B", None, b"nonsense", None, None)))
    sessions, messages = schemas.read_databases(spark, schemas.load("zed").sources[0].versions[0], [c])
    assert [(m.session_id, m.seq, m.role, m.content) for m in messages.orderBy("seq").collect()] == [("z", 0, "user", "hi"), ("z", 1, "assistant", "hm\nok")] and sessions.count() == 2
    with pytest.raises(Exception, match="no column nosuch"):
        schemas.query_databases(spark, [c], "SELECT id FROM threads", ["nosuch"]).collect()


def test_schemas_are_found_checked_and_overridden(tmp_path):
    assert schemas.listed() == ["claude", "codex", "copilot-cli", "opencode", "zed"]
    base = {"format": 1, "name": "own", "sources": [{"driver": "jsonl", "paths": [str(tmp_path)], "when": {"dir_exists": str(tmp_path)}, "versions": [{"version": 2, "sessions": {"id_from_filename": True}, "messages": {"role_field": "r", "content_path": "c"}}]}]}
    assert schemas.from_mapping(base).sources[0].versions[0].version == 2
    put(tmp_path, "claude.yaml", json.dumps(base | {"name": "claude"}))
    assert schemas.load("claude", str(tmp_path)).sources[0].versions[0].version == 2 and "claude" in schemas.listed(str(tmp_path))
    assert schemas.detect(schemas.from_mapping(base))[2] == [str(tmp_path)]
    assert schemas.detect(schemas.from_mapping(base | {"sources": [base["sources"][0] | {"when": {"dir_exists": "/nosuch"}}]})) is None
    db(str(tmp_path / "t.db"), ("CREATE TABLE a (x)",))
    source = {"driver": "sqlite", "paths": [str(tmp_path / "t*.db")], "versions": [{"version": v, "when": w, "sessions": {"query": "SELECT x FROM a", "id": "x"}, "messages": {"query": "SELECT x FROM a", "role": "x", "content": "x"}} for v, w in ((3, {"column_exists": ["a", "y"]}), (2, {"table_exists": "b"}), (1, {"table_exists": "a"}))]}
    assert schemas.detect(schemas.from_mapping(base | {"sources": [source]}))[1].version == 1
    for bad in ({"format": 2}, {"name": "../x"}, {"sources": []}, {"nosuch": 1}, {"sources": [source | {"driver": "nosuch"}]}, {"sources": [source | {"versions": [source["versions"][0] | {"sessions": {"query": "DELETE FROM a", "id": "x"}}]}]}, {"sources": [source | {"versions": [source["versions"][0] | {"sessions": {"query": "SELECT 1; DROP TABLE a", "id": "x"}}]}]}):
        with pytest.raises(schemas.SchemaError):
            schemas.from_mapping(base | bad)
    with pytest.raises(schemas.SchemaError):
        schemas.load("../claude")


def test_extractors(spark):
    page = b"<html><head><title>T</title><script>no()</script></head><body><h1>A &amp; B</h1><p>one <b>two</b></p><li>x</li></body></html>"
    assert extract.html_text(page) == "T\n\nA & B\n\none two\n\nx"
    w = io.BytesIO()
    with zipfile.ZipFile(w, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>')
    x = io.BytesIO()
    with zipfile.ZipFile(x, "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>a</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    rows = [("a.html", bytearray(page)), ("b.docx", bytearray(w.getvalue())), ("c.xlsx", bytearray(x.getvalue())), ("d.docx", bytearray(b"broken")), ("e.txt", bytearray(b"caf\xe9")), ("f.txt", None)]
    got = {r.path: r for r in extract.extract(spark.createDataFrame(rows, "path string, content binary").withColumn("name", F.col("path"))).collect()}
    assert got["b.docx"].text == "one two" and got["c.xlsx"].text == "## S\na | 5" and got["d.docx"].text is None and "BadZipFile" in got["d.docx"].error and got["e.txt"].text == "caf�" and got["f.txt"].text is None
    assert extract.chosen(None, None, None) is extract.built_in and extract.chosen(None, "x", "builtin", {"x": extract.plain_text}) is extract.plain_text
    with pytest.raises(KeyError):
        extract.chosen("nosuch", None, None)
