"""Run a registered query and its SQL counterpart and compare the values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6))
    return str(value)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    names = frame.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_plain(row[i]) for i in order) for row in frame.collect())


def difference(frame, con, sql: str) -> str:
    """Empty when both sides agree, else a short account of what differs."""
    left_names, left = spark_rows(frame)
    right_names, right = sql_rows(con, sql)
    if left_names != right_names:
        return f"columns {left_names} and {right_names}"
    if left == right:
        return ""
    only_left = sorted(set(left) - set(right))[:2]
    only_right = sorted(set(right) - set(left))[:2]
    return f"{len(left)} and {len(right)} rows; only spark {only_left}; only sql {only_right}"
