"""The registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("evaluation", "scoring", "preparation", "extras", "decisions", "exact", "containers", "patching", "sessions")


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
