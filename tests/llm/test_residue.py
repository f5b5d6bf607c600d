import pytest

from __spark_entry__ import queries
from siftlake.llm.residue import condemned, judge

PROSE = "The quiet index rewrites the ledger before lunch, and nobody noticed that it skipped 12 rows."


def case(text):
    evidence, residual = judge(text)
    return evidence and not residual


@pytest.mark.parametrize("slot", ["{{ first_name }}", "{{{title}}}", "{{#each rows}}", "{{ a | default }}", "{% block x %}", "<%= owner %>", "${name}", "#{team}", "$TEAM$", "%COUNT%", "%(title)s", "[YOUR NAME]", "[Insert date here]", "[insérer titre ici]", "[TITLE BURAYA]", "[OWNER]", "[[DUE_DATE]]", "<<count>>", "<your-team>", "{recipient}", "__VERSION__", "@@title@@", "*|NAME|*"])
def test_open_slots_but_not_in_code_or_quotation(slot):
    assert case(f"{PROSE} Contact {slot} for access.")
    assert case(slot)
    for kept in (f"Write `{slot}` there.", f'He typed "{slot}" twice.', f"```\n{slot}\n```\n{PROSE}", f"> {slot}\n{PROSE}"):
        assert not case(kept)


@pytest.mark.parametrize("text", ["See rows[0] and [note](x.md).", "Set {x | x > 3}; f{0} is first [see 4].", "log.info(f\"{a} of {b}\")\nreturn x\nimport os", "a {{", "100% of 5 %", PROSE, "", "  \n", None, "​"])
def test_no_case(text):
    assert not case(text)


@pytest.mark.parametrize("text", ["404 Not Found", "Error 500\nInternal Server Error", "Quiet index - Too Many Requests (429)", '{"error": {"code": 410, "message": "gone"}}', "Sorry, the note could not be loaded. Try again later.", "Die Seite wurde nicht gefunden.", "Accès refusé. Veuillez vous connecter.", "El documento no existe. Volver al inicio", "Belge bulunamadı.", 'Traceback (most recent call last):\n  File "/a/b.py", line 3, in f\nKeyError: 1', "Please enable JavaScript to see the content.", "Start > Docs\n\nDevam etmek için betikleri açın.", "Lorem ipsum dolor sit amet, elit sed ut magna.", "xxx " * 9, "foo bar " * 20, "ssf keafha qwwkj dfg qlqlghhs gkflaj jhkg", "Title\nText to follow.", "Heading 1\nClick to edit\nStep 2\n..."])
def test_nothing_but_evidence(text):
    assert case(text) and case(f"Home | Notes | Search\n{text}\nRef 1a2b")
    assert not case(f"{text}\n\n{PROSE}\n\n{PROSE}")


def test_recurrent_lines_of_a_host_are_subtracted(spark):
    banner = "This archive of the northern office collects what its readers have sent in over the years."
    rows = [(i, "h", f"{PROSE} {i}\n{banner}") for i in range(5)] + [(10, "h", f"404 Not Found\n{banner}"), (11, "g", f"404 Not Found\n{banner}"), (12, None, "502 Bad Gateway"), (12, None, "502 Bad Gateway"), (13, "h", None), (14, "h", ""), (None, "h", "404 Not Found")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS _k", "'x' AS residual", "0 AS line")
    assert sorted(r.doc_id for r in condemned(docs).collect()) == [10, 12]
    assert condemned(docs.limit(0)).count() == 0
    assert case("404 Not Found\n" + "x" * 300_000)


def test_query(spark, small):
    got = queries()["p10_found"](spark, small)
    assert got.dtypes == [("doc_id", "bigint")]
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids))
