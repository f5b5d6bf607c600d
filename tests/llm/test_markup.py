import pytest

from __spark_entry__ import queries
from siftlake.llm.markup import clean_text, clean_texts, counts, markup_counts, streams
from siftlake.plans.session import table


def seen(text, hint=""):
    return {s.language: tuple(counts(s)) for s in streams(text, hint)}


PLAIN = ["It cost $5 then and $7 now.", "The rule a < b and b > c held.", "#include and #define come first.", "See rows[0] and rows[1] (both empty).", "The file is C:\\temp\\section\\item.txt here.", "snake_case_name and __init__ stay.", "~/notes/[old]/x^2 is odd; 2 * 3 * 4 = 24.", "Map<String, List<Integer>> is it; {x | x > 0} too.", "R&D kept item #42 in C# and C++.", "At 5 o'clock we''ll see; <the usual address>, thanks <3", "100% of 5 rows", "set -x; ls | wc -l && echo ok"]


@pytest.mark.parametrize("text", [*PLAIN, "", "  \r\n", "x" * 300_000])
def test_plain_text_stays_as_it_is(text):
    for hint in ("", "html", "markdown", "latex", "wiki"):
        assert seen(text, hint) == {} and clean_text(text, hint) == text


def test_markdown():
    text = "---\ntitle: A\n---\n# One ##\n\nTwo\n---\n\n  ##### Three\n\n\\# kept\n\n- a\n   - b\n2) c\n\n* * *\n\n```go\n# no\n- no\n$a$\n```\n\nOutput:\n\n    # no\n\n    more\n\nEnd with $x^2$ and `$y$`, it cost $5 and $7.\n\n$$\na\n$$\n\n$$b$$\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n[1]: x.md"
    for ends in ("\n", "\r\n"):
        assert seen(text.replace("\n", ends)) == {"markdown": (3, 3, 2, 3)}
    clean = clean_text(text)
    assert clean.startswith("# One\n## Two\n##### Three\n# kept\n- a\n  - b\n- c\n```\n# no") and "x.md" not in clean and "$$ b $$" in clean
    for inline in ("Look ***there*** now.", "A [link](#top) here.", "It is `so` here.", "Was ~~old~~ new.", "An ![image](a.png) here."):
        assert seen(inline) == {"markdown": (0, 0, 0, 0)}


def test_html():
    text = "<!DOCTYPE html><html><head><title>T</title><style>h1 {}</style><script>var a = '<h2>no</h2>'; if (1 < 2) go();</script></head><body><h1 id=\"a>b\">\nOne\n</h1 ><UL><li>a<ul><li>b</ul><LI>c</LI></UL><!-- <h2>x</h2><li>y --><pre><code>&lt;li&gt;<li>\n\\(z\\)</code></pre><p>See \\(x\\) &amp; <code>k</code></p>\\[y\\]<div>$$z$$</div></body></html>"
    assert seen(text, "markdown") == {"html": (1, 3, 1, 3)}
    assert clean_text(text).startswith("# One\n- a\n  - b\n- c\n```\n<li>") and "See \\(x\\) & k" in clean_text(text)
    assert seen("One <b>word</b> here.") == seen("One&nbsp;word") == {"html": (0, 0, 0, 0)}


def test_wiki():
    text = "{{Infobox\n| name = A\n}}\n<!-- == old == -->\n== One ==\n===Two===\n*a\n** b\n#c\n# d<ref>n</ref>\n:<math>x</math>\nSee <math>y</math>, '''bold''' [[Main|it]] {{n|so}} <nowiki>no</nowiki>.\n<pre>\n* no\n== no ==\n</pre>\n<source lang=text>\n# no\n</source>\n{| class=\"g\"\n! a\n|-\n| 1\n|}\n----\n[[Category:X]]"
    assert seen(text) == {"wiki": (2, 4, 2, 2)}
    assert "See y, bold it so no." in clean_text(text)
    for inline in ("See [[there]] now.", "It is ''so'' here.", "That {{note|is}} it.", "Set <math>x</math> here."):
        assert seen(inline) == {"wiki": (0, 0, 0, int("math" in inline))}


def test_latex():
    text = "\\documentclass{article}\n\\title{T}\n\\begin{document}\n\\maketitle\n\\section*{One}\n% \\section{no}\n\\subsection{Two {\\it x}}\n\\begin{itemize}\n\\item a\n  \\item[--] b $x$\n\\item\n    c\n% \\item no\n\\end{itemize}\n\\begin{lstlisting}\n\\item no\n$a$ + $b$\n\\end{lstlisting}\n\\[ y \\]\n$$z$$\n\\begin{align*}\nq &= 1\n\\end{align*}\nA 5\\% cut of \\emph{it}~\\cite{b}.\n\\end{document}"
    assert seen(text, "html") == {"latex": (2, 3, 1, 4)}
    assert clean_text(text).startswith("# One\n## Two x\n- a\n- b x\n- c\n```") and "A 5% cut of it ." in clean_text(text)
    assert seen("Mark \\textbf{this} word.") == {"latex": (0, 0, 0, 0)}


def test_html_within_markdown_and_wiki():
    inner = "<div>\n<h3>H</h3>\n<ul><li>a</li><li>b</li></ul>\n</div>"
    assert seen(f"# One\n\n- x **y**\n\n{inner}") == {"markdown": (1, 1, 0, 0), "html": (1, 2, 0, 0)}
    assert seen(f"== One ==\n* x\n\n{inner}") == {"wiki": (1, 1, 0, 0), "html": (1, 2, 0, 0)}
    assert clean_text(f"# One\n\n{inner}") == "# One\n### H\n- a\n- b"


def test_operator(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "a.txt", None, "# A\n\n**b**", day(1)), (1, "a.txt", None, "== A ==\n''b''", day(2)), (1, "a.txt", None, "== A ==\n''b''", day(2)), (2, None, None, None, None), (3, "", "", "", day(1)), (None, "x.md", None, "# A", day(1)), (4, "p", None, "plain", day(1))]
    files = spark.createDataFrame(rows, "file_id int, path string, mime_type string, content string, scanned_at timestamp").selectExpr("*", "1 AS got", "2 AS at", "3 AS g")
    assert [tuple(r) for r in markup_counts(files).collect()] == [(1, "wiki", 1, 0, 0, 0)]
    assert {r.file_id: r.text for r in clean_texts(files).collect()} == {1: "## A\nb", 2: None, 3: "", 4: "plain"}
    assert markup_counts(files.limit(0)).count() == 0


def test_queries(spark, small):
    got = queries()["p1_found"](spark, small)
    assert got.dtypes == [("file_id", "bigint"), ("markup", "string"), ("headings", "bigint"), ("list_items", "bigint"), ("code_blocks", "bigint"), ("formulas", "bigint")]
    rows = got.collect()
    assert len(rows) == len({(r.file_id, r.markup) for r in rows}) > 10
    assert queries()["p1_text"](spark, small).count() == table(spark, small, "file_contents").select("file_id").distinct().count()
