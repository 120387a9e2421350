"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "quality", "secrets", "exact_dedup", "tiff", "prefix_bpe", "html_extract", "language_id", "sstable", "ngram_join")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"tabulon.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"tabulon.llm.{m}"), "ORACLE_SQL", {}).items()}
