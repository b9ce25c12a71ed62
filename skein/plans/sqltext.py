"""Helpers to write the DuckDB oracle text next to each Spark query."""

from __future__ import annotations


def with_(*ctes: tuple[str, str], materialize: bool = False) -> str:
    kw = " AS MATERIALIZED (" if materialize else " AS ("
    return "WITH " + ",\n".join(f"{name}{kw}{body}\n)" for name, body in ctes) + "\n"


def key(*parts: str) -> str:
    """Same text as Spark concat_ws(':', parts) for integer/string parts."""
    return " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"
