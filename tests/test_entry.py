import runpy
import sys

from siftlake import catalog


def test_the_optional_part_may_be_absent(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("siftlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("siftlake.llm", raising=False)
    monkeypatch.setitem(sys.modules, "siftlake.llm", None)
    names = set(runpy.run_path("__spark_entry__.py")["queries"]())
    assert "p2_found" in names and "t4_hybrid_search" in names and "p6_found" not in names


def test_every_query_with_sql_is_registered():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
