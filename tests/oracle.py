"""Run a registered query and its SQL over the same tables and compare."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return sorted((k, plain(v)) for k, v in value.items())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def canonical(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        Counter(repr([plain(row[i]) for i in order]) for row in rows),
    )


def spark_rows(frame) -> tuple[list[str], Counter]:
    return canonical(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(con, sql) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def difference(frame, con, sql) -> str | None:
    """None where both agree, else a short account of what differs."""
    (columns, ours), (their_columns, theirs) = spark_rows(frame), duck_rows(con, sql)
    if columns != their_columns:
        return f"columns {columns} against {their_columns}"
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; "
        f"only here {list((ours - theirs).items())[:2]}, only there {list((theirs - ours).items())[:2]}"
    )
