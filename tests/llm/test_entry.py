import runpy
import sys

import pytest


def test_a_fault_below_the_optional_part_is_raised(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("siftlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("siftlake.llm", raising=False)
    monkeypatch.setitem(sys.modules, "siftlake.llm.rankwalk", None)
    with pytest.raises(ImportError):
        runpy.run_path("__spark_entry__.py")["queries"]()
