"""Training-data operators: one module each, with the queries and SQL that apply them to the whole tables."""

from __future__ import annotations

from seamark.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
