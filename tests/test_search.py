import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftlake.functions import analysis, stems
from siftlake.operators import facets, filters, fusion, lexical, vector
from siftlake.operators.query import And, Field, Fuzzy, Near, Not, Or, Phrase, Prefix, QueryError, Term, parse, raw, read, text_of

DOCS = [
    (1, "Go", "The Go language is used for reliable and fast software, the Go authors say."),
    (2, "Python", "Python is a language for reliable software."),
    (3, "Rust", "Rust is a language. Memory is safe; crabs run quickly, running crabs."),
    (4, None, None), (5, "", "  "), (6, "İstanbul café", "Cafe CAFÉ café ıssız straße foo_bar-baz"),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string").selectExpr("*", "1 AS term", "2 AS field", "'x' AS size", "3 AS score")
    return lexical.build_index(docs)


def ids(index, query, **how):
    return [r.doc_id for r in lexical.search(index, query, **how).collect()]


def test_grammar():
    assert parse('"hello world"') == Phrase(("hello", "world"))
    assert parse("'a b") == Phrase(("a", "b"))
    assert parse("a AND b or c") == Or(And(Term("a"), Term("b")), Term("c"))
    assert parse("(a OR b) and NOT c") == And(Or(Term("a"), Term("b")), Not(Term("c")))
    assert parse("pref*") == Prefix("pref") and parse("hello~1") == Fuzzy("hello", 1) and parse("hello~") == Fuzzy("hello", 2)
    assert parse("Title:hello") == Field("title", Term("hello")) and parse("title:(a AND b)") == Field("title", And(Term("a"), Term("b")))
    assert parse("NEAR(hello world, 3)") == Near(("hello", "world"), 3) and parse("near(a b") == Near(("a", "b"), 5)
    assert parse("foo-bar") == Phrase(("foo", "bar")) and parse("42") == Term("42")
    assert parse("") is None and parse("  ") is None
    for bad in ("INVALID (", "a b", "a AND", "AND a", "(a", "a)", "a /b", "author:x", "NEAR(a)", "2fast"):
        with pytest.raises(QueryError):
            parse(bad)
        assert read(bad) == raw(bad)


def test_trees_as_text():
    for tree, plain, stemmed in [
        (Term("running"), "running", "run*"), (Term("the"), "the", "the"), (Phrase(("the", "running")), '"the running"', '"the run*"'), (Prefix("hel"), "hel*", "hel*"), (Fuzzy("running", 2), "running*", "run*"),
        (Field("title", Term("running")), "title:running", "title:run*"), (Near(("running", "jumps"), 5), "NEAR(running jumps, 5)", "NEAR(run* jump*, 5)"),
        (And(Term("running"), Not(Term("jumps"))), "(running NOT jumps)", "(run* NOT jump*)"), (Or(Term("a"), Term("b")), "(a OR b)", "(a OR b)"), (None, "", ""),
    ]:
        assert text_of(tree) == plain and text_of(tree, "en") == stemmed


def test_which_documents_match(index):
    assert sorted(ids(index, "language")) == [1, 2, 3]
    assert ids(index, "Go AND software") == [1] and sorted(ids(index, "reliable AND software")) == [1, 2]
    assert ids(index, "reliable software language fast") == [1]  # all words where the grammar is broken
    assert ids(index, "runs") == [3] and ids(index, "runs", stemming=False) == [] and ids(index, "crab") == []
    assert ids(index, '"reliable software"') == [2] and ids(index, '"software reliable"') == [] and ids(index, "title:rust") == [3] and ids(index, "content:python") == [2]
    assert sorted(ids(index, "NOT language")) == [4, 5, 6] and ids(index, "language AND NOT (go OR rust)") == [2]
    assert ids(index, "NEAR(reliable software, 1)") == [2] and sorted(ids(index, "NEAR(software reliable, 2)")) == [1, 2] and ids(index, "NEAR(software reliable, 0)") == [2]
    assert ids(index, "cafe") == ids(index, "CAFÉ") == ids(index, "istanbul") == ids(index, "ıssız") == ids(index, "straße") == ids(index, '"foo bar"') == [6] and ids(index, "issiz") == []
    assert ids(index, "") == [] and ids(index, "...") == [] and ids(index, "xyz*") == [] and ids(index, "*") == []


def test_scores_follow_the_formula(index):
    bags = {d: (re.findall(r"[a-z]+", (t or "").lower()), re.findall(r"[a-z]+", (x or "").lower())) for d, t, x in DOCS[:5]}
    sizes = {r.doc_id: r.size for r in index.lengths.collect()}
    mean = sum(sizes.values()) / 6
    tf = {d: 10 * t.count("go") + x.count("go") for d, (t, x) in bags.items()}
    df = sum(v > 0 for v in tf.values())
    want = max(math.log((6 - df + 0.5) / (df + 0.5)), 1e-6) * tf[1] * 2.2 / (tf[1] + 1.2 * (0.25 + 0.75 * sizes[1] / mean))
    assert lexical.search(index, "go", stemming=False).first().score == pytest.approx(want, abs=1e-9)
    both = {r.doc_id: r.score for r in lexical.search(index, "(go AND rust) OR language").collect()}
    alone = {r.doc_id: r.score for r in lexical.search(index, "language").collect()}
    assert both == pytest.approx(alone)  # a leaf counts only where the tree around it matched


def test_an_index_is_stored_and_read_again(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = lexical.Index.load(spark, str(tmp_path / "i"))
    assert ids(again, "language AND software") == ids(index, "language AND software") != []


def test_empty_index_limits_snippets_and_completions(spark, index):
    none = lexical.build_index(spark.createDataFrame([], "doc_id long, title string, text string"))
    assert ids(none, "a OR b") == [] and ids(none, "NOT a") == []
    assert ids(index, "language", limit=1) == ids(index, "language")[:1] and len(ids(index, "language", limit=0)) == 3
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    cut = {r.doc_id: r.s for r in docs.select("doc_id", lexical.snippet(F.col("text"), ["language"], 4).alias("s")).collect()}
    assert cut[1].startswith("...") and ">>>language<<<" in cut[1] and cut[4] is None and cut[5] == ""
    terms = spark.createDataFrame([(w,) for w in "hello help helm world word hello h".split()], "term string")
    assert [r.term for r in lexical.completions(terms, "hel").collect()] == ["hello", "helm", "help"] and lexical.completions(terms, "", 2).count() == 2 and lexical.completions(terms, "xyz").count() == 0


def test_analysis(spark):
    assert analysis.analyzed_words("the quick brown fox jumps over the lazy dog") == ["quick", "brown", "fox", "jump", "lazi", "dog"]
    assert [stems.english(w) for w in "running runs ran studies jumping lazy relational hopping".split()] == ["run", "run", "ran", "studi", "jump", "lazi", "relat", "hop"]
    assert [stems.turkish(w) for w in "kitaplar evlerde arabam notlarım koşuyor koşmak".split()] == ["kitap", "ev", "araba", "not", "koşuyor", "koşmak"]
    assert analysis.analyzed_words("les chats", "fr") == ["les", "chats"] and analysis.is_stop_word("ve", "tr") and not analysis.is_stop_word("ve", "en")
    assert analysis.query_terms("the running dogs") == ["run*", "dog*"] and len(analysis.ENGLISH_STOPS) == 86 and len(analysis.TURKISH_STOPS) == 41
    df = spark.createDataFrame([("Running foo_bar the ÉTÉ",), (None,), ("",)], "t string")
    assert [list(r[0] or []) for r in df.select(analysis.analyzed(F.col("t"))).collect()] == [["run", "foo_bar", "été"], [], []]


def test_vectors(spark):
    rows = [(1, [0.99, 0.1]), (2, [0.1, 0.99]), (3, [0.6, 0.8]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in vector.nearest(df, [1.0, 0.0], 2).collect()] == [1, 3] == [r.chunk_id for r in vector.approximate(df, [1.0, 0.0], 2).collect()]
    scores = {r.chunk_id: r.score for r in vector.nearest(df, [1.0, 0.0], 9).collect()}
    assert scores[5] == scores[6] == scores[7] == 0.0 and 4 not in scores
    with pytest.raises(Exception, match="dimension 2"):
        vector.check_dimension(df.filter("embedding IS NOT NULL"), "embedding", 2).collect()
    assert vector.index_of("hnsw") is vector.approximate and vector.index_of("nosuch") is vector.nearest is vector.index_of(None)
    back = df.filter("chunk_id < 5").select(vector.decode_blob(vector.encode_blob(F.col("embedding")))).collect()
    assert [None if r[0] is None else len(r[0]) for r in back] == [2, 2, 2, None]


def test_fusion(spark):
    one = fusion.with_rank(spark.createDataFrame([(d, f"l{d}", -float(d)) for d in range(5)], "doc_id long, title string, score double"), F.desc("score"))
    two = fusion.with_rank(spark.createDataFrame([(0, "v0", 0.9), (9, "v9", 0.8), (9, "v9b", 0.7)], "doc_id long, title string, score double"), F.desc("score"))
    fused = {r.doc_id: r for r in fusion.fuse_with_rows(one, two).collect()}
    assert len(fused) == 6 and fused[0].score == pytest.approx(2 / 61) and fused[0].title == "l0" and fused[9].title == "v9" and fused[9].score == pytest.approx(1 / 62 + 1 / 63)
    assert [r.doc_id for r in fusion.hybrid(one, None, 2).collect()] == [0, 1] and fusion.candidates_of(0) == 40 and fusion.candidates_of(5, True) == 15
    texts = one.withColumn("content", F.concat(F.lit("word "), F.col("title")))
    assert fusion.rerank(texts, fusion.overlap_scorer, "l3 word").orderBy(F.desc("score")).first().doc_id == 3
    assert [r.doc_id for r in fusion.rerank(texts, lambda q, t: 1 / 0, "x").collect()] == [0, 1, 2, 3, 4] and fusion.rerank(texts, lambda q, t: [(99, 1.0)], "x").count() == 5
    values = spark.createDataFrame([(1, 5), (2, 3), (3, 5)], "doc_id long, value int")
    assert [r.doc_id for r in fusion.sort_by_field(one, values).collect()] == [2, 1, 3, 0, 4] and [r.doc_id for r in fusion.sort_by_field(one, values, True).collect()] == [1, 3, 2, 0, 4]


def test_filters(spark):
    assert re.match(filters.glob_pattern("work/*.m[de]"), "work/a/b.md") and not re.match(filters.glob_pattern("Work/*"), "work/a") and re.match(filters.glob_pattern("a\\?[!x]"), "a/bc")
    with pytest.raises(ValueError):
        filters.glob_pattern("a/../b")
    rows = spark.createDataFrame([("c", "code", "2024-01-02 00:00:00", "a/b.go", "Go", 1), ("d", "code", "2024-01-03 00:00:00", "a/b.py", None, None)], "collection string, coll_type string, created_at string, path string, lang string, chunk_type int")
    count = lambda **f: filters.FilterSet(**f).apply(rows).count()
    assert count() == 2 and count(collection="c") == 1 and count(coll_type="x") == 0 and count(since="2024-01-02T00:00:00Z", until="2024-01-03") == 1 and count(path="*.py") == 1
    assert count(fields=(("lang", "GO"),)) == 1 and count(chunk_type="image") == 1 and count(chunk_type="text") == 1
    v = spark.createDataFrame([(None,), ("2024-01-01T00:00:00Z",), ("1.5",), ("x",), ("{}",)], "v string")
    ok = {kind: [r[0] for r in v.select(filters.valid(F.col("v"), kind)).collect()] for kind in ("date", "int", "json", "text", "bool")}
    assert ok == {"date": [True, True, False, False, False], "int": [True, False, True, False, False], "json": [True, False, True, False, True], "text": [True] * 5, "bool": [True, False, False, False, False]}


def test_facets(spark):
    rows = spark.createDataFrame([("readme.md", "docs", "text", 50, "2023-01-15 10:00:00"), ("guide.md", "docs", "text", 150, "2023-02-20 10:00:00"), ("main.go", "src", "code", 600, "2023-02-25 10:00:00"), ("utils.go", "src", "code", 50, "2023-03-05 10:00:00"), ("test.go", "src", "code", 200, "2023-03-10 10:00:00")], "path string, collection string, coll_type string, line_count int, created_at string")
    got = lambda spec: [tuple(r) for r in facets.facet(rows, spec).collect()]
    assert got("collection:terms") == [("src", 3), ("docs", 2)] and got("type:terms") == [("code", 3), ("text", 2)] and got("count") == got("x:count") == [("count", 5)]
    assert got("date:histogram:month") == got("created_at:histogram:eon") == [("2023-01", 1), ("2023-02", 2), ("2023-03", 2)]
    assert got("line_count:range") == [("0-100", 2), ("100-500", 2), ("500-", 1)] and got("line_count:range:0-10,10-100") == [("10-100", 2), ("other", 3)]
    for bad in ("terms", "a:nosuch", "", "nosuch:terms", "path`; DROP:terms"):
        with pytest.raises(facets.SpecError):
            facets.facet(rows, bad).collect()
    assert facets.facet(rows.limit(0), "count").first()["count"] == 0 and facets.facet(rows.limit(0), "collection:terms").count() == 0
    assert set(facets.facets(rows, ["count", "type:terms"])) == {"count", "type:terms"}


def test_word_counts_agree_with_plain_python(spark, small):
    from siftlake.plans.session import table

    docs = table(spark, small, "documents", "doc_id", "text")
    want = Counter(w for r in docs.collect() for w in analysis.index_words(r.text or ""))
    got = {r.term: r.n for r in docs.select(F.explode(analysis.index_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(want.values()) == pytest.approx(sum(got.values()), rel=0.001) and sum(got.get(w, 0) == n for w, n in want.items()) > 0.99 * len(want)
