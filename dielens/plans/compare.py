"""Compare a registered query with its SQL counterpart, for tests and the check tool."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return "int-or-decimal", str(value)
    if isinstance(value, bool):
        return "bool", value
    if isinstance(value, int):
        return "int", value
    if isinstance(value, float):
        return "float", "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return "time", value.replace(tzinfo=None).isoformat()
    return type(value).__name__, value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, connection, sf, name, fn, sql) -> str | None:
    """None where both agree, else a short account."""
    frame = fn(spark, sf)
    got = frame.collect()
    if sql is None:
        return None if got else "no rows"
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} but expected {sorted(names)}"
    left, right = _rows(frame.columns, got), _rows(names, want)
    if left == right:
        return None if left else "both are empty"
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return f"{len(left)} rows, expected {len(right)}; {sorted(names)}\n got {only_left}\n want {only_right}"
