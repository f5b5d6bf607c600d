import io
import json
import os

import pytest
from pyspark.sql import functions as F

from siftlake import cli
from siftlake.engine import Engine
from siftlake.operators import embed, filters
from siftlake.operators.store import Store
from siftlake.streaming import sync as stream


def put(root, name, text):
    at = os.path.join(root, name)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    put(root, "notes/a.md", "# Alpha\nThe index rewrites the ledger.\n\n# More\nOther words here.")
    put(root, "notes/b.md", "# Beta\nA parser splits the vector.")
    put(root, "src/x.go", "package x\n\nfunc Ledger() {}")
    put(root, "docs/p.html", "<h1>Gamma</h1><p>ledger of pages</p>")
    e = Engine(spark, str(root / "store"))
    assert e.add("notes", "markdown", str(root / "notes")) == {"insert": 2} and e.add("src", "code", str(root / "src")) == {"insert": 1} and e.add("docs", "document", str(root / "docs")) == {"insert": 1}
    e.embed()
    e.root = root
    return e


def titles(found):
    return [r.title for r in found.collect()]


def test_search_by_words_by_vector_and_by_both(engine):
    assert set(titles(engine.search("ledger", "lexical"))) == {"Alpha", "x.go", "p.html"}
    assert titles(engine.search("index rewrites ledger", "vector", 1)) == ["Alpha"] and titles(engine.search("ledger AND index"))[0] == "Alpha"
    assert titles(engine.search("ledger", "lexical", narrowed=filters.FilterSet(coll_type="code"))) == ["x.go"]
    assert titles(engine.search("ledger", narrowed=filters.FilterSet(fields=(("lang", "Go"),)))) == ["x.go"]
    r = engine.search("other", "hybrid", 1).collect()[0]
    assert r.title == "Alpha" and r.location.endswith("a.md:L4-L5") and r.line == "# More Other words here."
    assert engine.search("other", "hybrid", 1, context=1).collect()[0].content == "# Alpha\nThe index rewrites the ledger.\n\n# More\nOther words here."
    assert titles(engine.search("ledger", "lexical", sort_by="line_count")) == ["p.html", "x.go", "Alpha"] and engine.search("nosuch", "lexical").count() == 0
    assert [(r.key, r["count"]) for r in engine.facets(["collection:terms"])["collection:terms"].collect()] == [("notes", 2), ("docs", 1), ("src", 1)]
    assert [r.term for r in engine.complete("le").collect()] == ["ledger"]


def test_sync_again(engine):
    assert engine.sync("notes") == {"skip": 2}
    put(engine.root, "notes/b.md", "# Beta2\nNothing.")
    put(engine.root, "notes/c.md", "new")
    assert engine.sync("notes") == {"skip": 1, "update": 1, "insert": 1} and engine.search("parser", "lexical").count() == 0
    os.remove(engine.root / "notes/c.md")
    assert engine.sync("notes") == {"skip": 2, "delete": 1}
    assert engine.store.read("chunks").filter("embedding IS NULL").count() == 1  # a changed chunk waits for its vector
    os.rename(engine.root / "src", engine.root / "gone")
    with pytest.raises(FileNotFoundError):
        engine.sync("src")  # a folder that is not there deletes nothing
    assert {r.name: r.n_docs for r in engine.status().collect()} == {"docs": 1, "notes": 2, "src": 1}
    with pytest.raises(KeyError):
        engine.sync("nosuch")


def test_command_line(spark, engine, tmp_path):
    def run(*argv):
        out = io.StringIO()
        code = cli.main(["--store", str(engine.root / "store"), *argv], spark, out)
        return code, out.getvalue()

    assert run("analyze", "the running dogs") == (0, "run dog\n")
    assert "p.html" in run("search", "pages", "--mode", "lexical")[1] and json.loads(run("search", "pages", "--json", "--limit", "1")[1].splitlines()[0])["title"] == "p.html"
    assert run("search", "ledger", "--facet", "count")[1].splitlines()[-1] == 'count [["count", 4]]'
    assert "docs\t1 documents\t1 chunks" in run("status")[1] and run("complete", "pag")[1] == "pages\n" and run("sync")[0] == 1 and run("sync", "docs") == (0, 'docs {"skip": 1}\n')
    assert run("schema")[1].startswith("{") and "zed\t-" in run("parsers")[1]
    put(tmp_path, "c.yaml", "limit: 3\nlanguage: $SIFT_LANG\nchunk: {max: 5}")
    os.environ["SIFT_LANG"] = "tr"
    assert cli.config(str(tmp_path / "c.yaml")) == cli.DEFAULTS | {"limit": 3, "language": "tr", "chunk": {"max": 5, "overlap": 100}}


def test_embedding(spark):
    asked = []

    def service(texts):
        asked.append(len(texts))
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(9)] + [(9, " ")], "chunk_id long, content string").coalesce(1)
    got = {r.chunk_id: r.embedding for r in embed.embedded(rows, service).collect()}
    assert got[8] == [8.0] and got[0] is None and got[9] is None
    assert embed.in_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}, {"index": 7}], 3) == [[1.0], [2.0], None]
    a, b, c = embed.hashing_embedder(32)(["One two", "two ONE", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and c == [0.0] * 32
    items = [{"image": "i"}] * 7 + [{"text": "t"}] * 20
    assert [len(x) for x in embed.mixed_batches(items)] == [5, 20, 2] and embed.mixed_batches([]) == []
    assert embed.batch_vectors('{"custom_id": "a", "response": {"body": {"data": [{"embedding": [1]}]}}}\nbroken\n{"custom_id": "b", "error": 1}') == {"a": [1]} and embed.request_lines([("a", "t")], "m").count("\n") == 1
    assert embed.is_multimodal("qwen3-vl-embedding") and not embed.is_multimodal("bge-m3") and embed.image_item(b"x", "image/png")["image"] == "data:image/png;base64,eA=="


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = lambda p, h, day: (1, p, "t", "c", h, 1.0, 1, f"2024-01-0{day} 00:00:00")
    arrive = lambda n, *rows: spark.createDataFrame(list(rows), stream.LISTING.replace("seen_at timestamp", "seen_at string")).withColumn("seen_at", F.col("seen_at").cast("timestamp")).write.parquet(str(tmp_path / f"in/{n}"))

    def run():
        q = stream.start(stream.listings(spark, str(tmp_path / "in/*")), stream.upsert_batches(store), str(tmp_path / "ck"))
        q.awaitTermination()

    arrive(1, row("a", "h1", 1), row("a", "h2", 2), row("b", "h1", 1))
    run()
    assert {r.path: r.content_hash for r in store.read("documents").collect()} == {"a": "h2", "b": "h1"}
    version = store.version()
    run()
    arrive(2, row("b", "h1", 3))
    run()
    assert store.version() == version  # nothing new, and an unchanged document
    arrive(3, row("b", "h3", 4))
    run()
    assert {r.path: r.content_hash for r in store.read("documents").collect()} == {"a": "h2", "b": "h3"}
