"""Queries by name, as the driver calls them, and their SQL equivalents."""

from __future__ import annotations

from . import analysis, found, store, text

_MODULES = (text, store, analysis, found)


def all_queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
