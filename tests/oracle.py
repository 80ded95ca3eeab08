"""Side-by-side run of the registered queries and their SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(result, connection, sql):
    """Differences between a Spark result and a SQL result, empty when they agree."""
    expected = connection.execute(sql)
    names = [column[0] for column in expected.description]
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} against {sorted(names)}"]
    wanted = rows_of(names, expected.fetchall())
    found = rows_of(result.columns, [tuple(row) for row in result.collect()])
    if len(wanted) != len(found):
        return [f"{len(found)} rows against {len(wanted)}"]
    return [f"{f} against {w}" for f, w in zip(found, wanted) if f != w]
