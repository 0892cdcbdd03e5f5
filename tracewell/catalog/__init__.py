"""Registered queries and their SQL counterparts, one module per family."""

from __future__ import annotations

import importlib

_MODULES = ["extents", "payloads", "timeline", "ledger", "fragments", "streams", "media", "evidence", "volumes"]


def _load():
    return [importlib.import_module(f"tracewell.catalog.{name}") for name in _MODULES]


def all_queries() -> dict:
    found: dict = {}
    for module in _load():
        found.update(module.QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _load():
        found.update(module.SQL)
    return found
