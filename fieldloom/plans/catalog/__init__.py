"""Registered queries, one module per group of operators."""

from __future__ import annotations

from importlib import import_module

from fieldloom.plans.catalog.adapters import Query

MODULES = ["tapes", "segments", "sources", "ensembles", "comparison", "enrich", "rule_tables", "mapping", "reports", "jobs"]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found.update(import_module(f"fieldloom.plans.catalog.{name}").QUERIES)
    return found
