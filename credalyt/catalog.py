"""All queries of the library by name, with their DuckDB forms."""

from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval", "prep", "evaluation", "texts", "operations", "models", "answers", "storage", "stored")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"credalyt.queries.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
