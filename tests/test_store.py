import pytest
from pyspark.sql import functions as F

from siftlake.operators import chunks, lexical, sync
from siftlake.operators.store import Store, document_id, rebuilt_text

DOC = "collection_id long, path string, title string, content string, content_hash string, mtime double, line_count int"


def docs(spark, cid, *rows):
    return spark.createDataFrame([(cid, p, t, c, h, 1.0, 1) for p, t, c, h in rows], DOC)


def with_chunks(d, kind="markdown"):
    keyed = d.select(document_id(F.col("collection_id"), F.col("path")).alias("doc_id"), "content")
    return chunks.chunk_documents(keyed, kind, text="content")


def test_life_of_a_document(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.read("documents").count() == 0 and s.version() == 0
    cid = s.create_collection("notes", "markdown", "/n", "*.md")
    assert s.create_collection("notes", "code", "/other") == cid and s.collections().count() == 1
    a = docs(spark, cid, ("a.md", "A", "one two", "h1"), ("b.md", "B", "three", "h2"))
    s.upsert(a, with_chunks(a), spark.createDataFrame([(1, "lang", "go")], "doc_id long, field string, value string").limit(0))
    first = {r.path: r for r in s.read("documents").collect()}
    assert set(first) == {"a.md", "b.md"} and s.read("chunks").count() == 2
    b = docs(spark, cid, ("a.md", "A2", "changed", "h3"))
    s.upsert(b, with_chunks(b))
    second = {r.path: r for r in s.read("documents").collect()}
    assert second["a.md"].title == "A2" and second["a.md"].doc_id == first["a.md"].doc_id and second["a.md"].created_at == first["a.md"].created_at and second["a.md"].updated_at > first["a.md"].updated_at
    assert second["b.md"] == first["b.md"] and {r.content for r in s.read("chunks").collect()} == {"changed", "three"}
    assert s.read("documents", s.version() - 1).filter("title = 'A'").count() == 1  # the version before is still whole
    ids = spark.createDataFrame([(first["a.md"].doc_id,)], "doc_id long")
    s.append_text(ids.withColumn("text", F.lit("more")), ids.withColumn("seq", F.lit(0)).withColumn("content", F.lit("more")))
    assert s.read("documents").filter("path = 'a.md'").first().content == "changed\nmore" and [r.seq for r in s.read("chunks").join(ids, "doc_id").orderBy("seq").collect()] == [0, 1]
    s.set_fields(ids.select("doc_id", F.lit("lang").alias("field"), F.lit("go").alias("value")))
    s.set_fields(ids.select("doc_id", F.lit("lang").alias("field"), F.lit("rust").alias("value")))
    both = s.fields_of(s.read("documents"))
    assert {r.doc_id: r.fields for r in both.collect()} == {first["a.md"].doc_id: {"lang": "rust"}, first["b.md"].doc_id: {}}
    s.update("documents", ids.withColumn("mtime", F.lit(9.0)), "doc_id")
    assert {r.path: r.mtime for r in s.read("documents").collect()} == {"a.md": 9.0, "b.md": 1.0}
    assert [r.doc_id for r in lexical.search(s.load_index(), "more").collect()] == [first["a.md"].doc_id] and lexical.search(s.load_index(), "two").count() == 0
    assert {r.title: r.content for r in rebuilt_text(s.read("documents"), s.read("chunks")).collect()} == {"A2": "changed\nmore", "B": "three"}
    s.delete_fields(ids)
    s.delete_documents(ids)
    assert s.read("documents").count() == 1 and s.read("chunks").count() == 1
    s.delete_collection("notes")
    assert all(s.read(t).count() == 0 for t in ("collections", "documents", "chunks", "fields"))


def test_one_of_two_writers_wins_and_a_failed_change_leaves_no_trace(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create_collection("a", "code", "/a")
    broken = docs(spark, 1, ("x", "X", "x", "h")).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        s.upsert(broken)
    assert s.version() == 1 and s.read("documents").count() == 0
    other = Store(spark, str(tmp_path / "s"))
    held = other.version
    other.version = lambda: 0
    with pytest.raises(RuntimeError):
        other.commit(fields=s.read("fields"))
    other.version = held
    assert other.version() == 1


def test_sync_script(spark, tmp_path):
    """Empty, added, unchanged, touched, changed, failed in part, deleted."""
    old = lambda *r: spark.createDataFrame(list(r), "collection_id long, path string, content_hash string, mtime double")
    act = lambda scan, store, **how: {r.path: r.action for r in sync.sync_actions(scan, store, **how).collect()}
    assert act(old(), old()) == {}
    assert act(old((1, "a", "h", 1.0)), old()) == {"a": "insert"} and act(old((1, "a", "h", 1.0)), old((1, "a", "h", 1.0))) == {"a": "skip"}
    assert act(old((1, "a", "h", 2.0)), old((1, "a", "h", 1.0))) == {"a": "touch"} and act(old((1, "a", "h", 2.0)), old((1, "a", "h", 1.0)), coll_type="pdf") == {"a": "skip"}
    assert act(old((1, "a", "i", 1.0)), old((1, "a", "h", 1.0))) == {"a": "update"} and act(old((1, "a", None, 1.0)), old((1, "a", "h", 1.0))) == {"a": "skip"}
    assert act(old(), old((1, "a", "h", 1.0))) == {"a": "delete"} and act(old(), old((1, "a", "h", 1.0)), failed=True) == {"a": "skip"}
    assert act(old((1, "a", "h", 1.0), (1, "a", "h", 1.0), (None, None, "h", 1.0)), old()) == {"a": "insert"}
    log = lambda *r: spark.createDataFrame(list(r), "path string, mtime double, line_count int")
    got = {r.path: (r.action, r.from_line) for r in sync.conversation_actions(log(("new", 5.0, 3), ("same", 5.0, 3), ("more", 6.0, 9), ("less", 6.0, 2)), log(("same", 5.0, 3), ("more", 5.0, 4), ("less", 5.0, 4))).collect()}
    assert got == {"new": ("insert", 0), "same": ("skip", 0), "more": ("append", 4), "less": ("touch", 0)}


def test_titles_and_transcripts(spark):
    rows = [("s", 0, "system", "x"), ("s", 1, "user", "first\nline"), ("s", 2, "assistant", "a"), ("t", 0, "assistant", None)]
    t = {r.session_id: r for r in sync.transcript(spark.createDataFrame(rows, "session_id string, seq int, role string, content string")).collect()}
    assert t["s"].transcript == "[system]: x\n\n[user]: first\nline\n\n[assistant]: a\n\n" and t["s"].title_text == "first\nline" and t["t"].transcript == "[assistant]: \n\n" and t["t"].n_messages == 1
    titles = spark.createDataFrame([("T", "u", "s"), (" ", "first\nline", "s"), (None, "y" * 120, "s"), (None, None, "s")], "a string, b string, c string")
    assert [r[0] for r in titles.select(sync.session_title(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["T", "first", "y" * 100 + "...", "s"]
    blocks = spark.createDataFrame([("s", 1, "look"), ("s", 2, None), ("s", 3, "")], "session_id string, seq int, text string")
    assert [r.context for r in sync.last_text_before(blocks).orderBy("seq").collect()] == ["look"] * 3


def test_chunkers(spark):
    md = chunks.markdown_chunks
    assert md("# H\nbody") == ["# H\nbody"] and md("") == md(" \n ") == [] and len(md("# a\nx\n# b\ny\n# c\nz")) == 3 and len(md("intro\n# a\n# b")) == 3
    text = "\n\n".join(f"word{i} " * 20 for i in range(10))
    pieces = md(text, 500, 50)
    assert len(pieces) >= 2 and all(len(p.encode()) <= 554 for p in pieces) and md("x" * 5000) == ["x" * 5000]
    assert chunks.conversation_chunks("a\n" * 10, 8) == ["a\na\na\na"] * 2 + ["a\na"] and chunks.conversation_chunks("x" * 30 + "\ny", 8) == ["x" * 30, "y"] and chunks.conversation_chunks("\n\n") == []
    assert chunks.code_chunks("") == [] and chunks.code_chunks("  a\n\nb ") == ["a\n\nb"]
    code = "\n\n".join(f"def f{i}():\n    return {i}" for i in range(20))
    pieces = chunks.code_chunks(code, 100, 20)
    assert all(len(p) <= 124 for p in pieces) and all(f"def f{i}():" in " ".join(pieces) for i in range(20))
    wide = chunks.code_chunks("é" * 300, 100, 10)
    assert all(len(p.encode()) <= 100 for p in wide) and set("".join(wide)) == {"é"} and len("".join(wide)) >= 300
    assert chunks.line_spans("\n\n# a\nx\n# b\ny", ["# a\nx", "# b\ny"]) == [(3, 4), (5, 6)]
    rows = spark.createDataFrame([(1, "# a\nx\n# b\ny"), (2, None), (3, "  ")], "doc_id long, text string").selectExpr("*", "1 AS seq", "'x' AS content")
    got = [tuple(r) for r in chunks.chunk_documents(rows, "markdown").orderBy("seq").collect()]
    assert got == [(1, 0, "# a\nx", 1, 2), (1, 1, "# b\ny", 3, 4)]


def test_context(spark):
    rows = [(1, 0, "a", 1, 30), (1, 1, "b", 31, 60), (1, 2, "c", 61, 90), (1, 2, "c2", 61, 95), (2, 0, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, content string, start_line int, end_line int")
    hit = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, seq int")
    got = lambda r: {x.doc_id: (x.context, x.from_line, x.to_line) for x in chunks.with_context(hit, df, r).collect()}
    assert got(0) == {1: ("b", 31, 60), 2: ("", None, None)} and got(1)[1] == ("a\n\nb\n\nc\n\nc2", 1, 95)
