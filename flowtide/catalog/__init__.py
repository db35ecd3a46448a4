"""Registered queries: each name maps to a Spark callable and, where SQL can say the same over
whole tables, to the equivalent SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("detection", "alerting", "macroflows", "preparation", "reputation", "reporting", "evaluation",
           "training", "live", "files")


def _entries() -> dict[str, tuple]:
    merged: dict[str, tuple] = {}
    for name in MODULES:
        for key, entry in import_module(f"flowtide.catalog.{name}").ENTRIES.items():
            if key in merged:
                raise ValueError(f"query {key} registered twice")
            merged[key] = entry
    return merged


def queries() -> dict:
    return {name: fn for name, (fn, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
