"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontam", "htmltext", "kdshard", "langid", "matroska", "packing", "quality", "simhash", "suffixdedup", "token_orc")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"quillon.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"quillon.llm.{m}").ORACLE.items()}
