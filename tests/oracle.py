"""Compare a Spark result with its DuckDB oracle: columns, row count and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, decimal.Decimal, float)):
        number = float(value)
        return int(number) if number == int(number) else repr(round(number, 9))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value) if not isinstance(value, str) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    table = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(table, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both results agree, else what differs."""
    cursor = con.execute(sql)
    want_names, want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only spark {sorted(set(got) - set(want), key=repr)[:3]}; only sql {sorted(set(want) - set(got), key=repr)[:3]}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(diff)} rows differ; {got_names}; only spark {sorted(set(got) - set(want), key=repr)[:3]}; only sql {sorted(set(want) - set(got), key=repr)[:3]}"
    if not got:
        return "empty on both sides"
    return None
