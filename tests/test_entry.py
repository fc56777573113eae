"""The driver's entry with and without the optional subpackage."""

from __future__ import annotations

import sys

import __spark_entry__ as entry


def test_queries_without_the_optional_subpackage(monkeypatch) -> None:
    whole, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= whole and "hybrid_recall" in whole
    monkeypatch.setitem(sys.modules, "memtide.llm.queries", None)  # as if a library that it needs were missing
    rest = set(entry.queries())
    assert rest == {n for n in whole if n != "pipeline" and not n.startswith("op")}
    assert set(entry.oracle_sql()) <= rest
