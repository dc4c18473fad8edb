"""All core queries by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_text", "q_candidates", "q_joins", "q_reports", "q_splits", "q_usage", "q_more", "q_assembly", "q_stream", "q_sources")


def _parts() -> list:
    return [import_module(f"rankloom.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: query for part in _parts() for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.SQL.items()}
