"""Named queries over the given tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["cleaning", "featuring", "demand", "vectors", "texts", "files", "models"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(import_module(f"tallyloom.registered.{m}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
