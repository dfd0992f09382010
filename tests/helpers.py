"""Comparison of a Spark query with its SQL twin."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = [tuple(canonical(r[i]) for i in order) for r in rows]
    return names, sorted(body, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(df, con, sql) -> str | None:
    cur = con.execute(sql)
    want_names, want = table([d[0] for d in cur.description], cur.fetchall())
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return f"columns: spark {got_names} sql {want_names}"
    if len(want) != len(got):
        return f"rows: spark {len(got)} sql {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; columns {got_names}; first spark {bad[0][0]} sql {bad[0][1]}"
    return None
