"""The named queries of the text operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1_lookalike", "p2_components", "p3_overlap", "p4_pii", "p5_sampling", "p6_packing", "p7_mixing", "p8_residue")


def _parts() -> list:
    return [import_module(f"rankloom.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {name: query for part in _parts() for name, query in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _parts() for name, sql in part.SQL.items()}
