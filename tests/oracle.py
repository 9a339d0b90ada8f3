"""Run a query in Spark and its SQL in DuckDB, and compare rows as multisets."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return repr(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    names = df.columns
    got = rows_of(names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    wanted_names = [d[0] for d in cur.description]
    want = rows_of(wanted_names, cur.fetchall())
    if sorted(names) != sorted(wanted_names):
        return f"columns {sorted(names)} != {sorted(wanted_names)}"
    if got != want:
        extra, lacking = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} vs {sum(want.values())} rows; only spark {extra}; only sql {lacking}"
    if not got:
        return "both empty"
    return None
