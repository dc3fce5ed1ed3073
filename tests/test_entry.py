"""The registries: SQL belongs to queries, and the core stands without the text operators."""

from __future__ import annotations

import importlib.util
import re
from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "skein.llm" else real(name, *a))
    names = set(entry.queries())
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p6_found"} <= names and not names & {"p5_found", "p7_ids", "p8_mixture", "p9_found"}
    root = Path(entry.__file__).parent
    for p in (root / "skein").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(?:from|import) skein\.llm", p.read_text()), p


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 10
