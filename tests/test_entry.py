"""The driver's entry points, and that they work where the training-data operators aren't installed."""

import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("flowline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "flowline.llm", None)  # as if it weren't there
    assert "session_fold" in entry.queries() and not any(q.startswith("op") and q[2].isdigit() for q in entry.queries())


def test_nothing_else_imports_llm():
    root = Path(entry.__file__).parent / "flowline"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any("llm" in p.read_text() for p in others)
