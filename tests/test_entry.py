"""The driver contract without the optional parts."""

import sys

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("missing", ["stowage.llm", "public_tokenizers"])
def test_core_queries_without_optional_parts(monkeypatch, missing):
    for name in [m for m in sys.modules if m.startswith("stowage.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import stowage

    monkeypatch.delattr(stowage, "llm", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)
    found = entry.queries()
    assert "compare_rows" in found and not any(name.startswith("op") and name[2].isdigit() for name in found)
    assert set(entry.oracle_sql()) <= set(found)
