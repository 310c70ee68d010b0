"""All queries of the document-analytics operators, by name, with SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "metrics", "screening", "dedupe", "retrieval", "structure", "linking", "rules", "sequential", "graph", "ranking", "evidence", "resolution", "sections", "spans", "labels", "recency", "schema_evidence", "extraction")


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for name in MODULES:
        found |= import_module(f"scriptorium.operators.{name}").queries()
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
