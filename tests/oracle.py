"""Compare a query with its SQL on the same tables, order aside."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, datetime.datetime):
        return (value.astimezone(datetime.UTC).replace(tzinfo=None) if value.tzinfo else value).isoformat()
    return str(value)


def rows(names: list[str], values) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(plain(row[i]) for i in order) for row in values)


def check(spark, con, folder: str, query, sql: str) -> None:
    found, cursor = query(spark, folder), con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, cursor.fetchall())
