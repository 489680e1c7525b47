"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("rows", "grouped", "joined", "combined", "placed", "made", "pipelines", "scenarios")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"quillon.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"quillon.plans.{m}").ORACLE.items()}
