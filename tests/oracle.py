"""Runs a query and its SQL twin on the same tables and compares every value."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> str:
    """'' when equal, else what differs."""
    cols, got = _rows(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = _rows(names, cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first only-ours {[x for x in got if x not in set(want)][:2]} only-theirs {[x for x in want if x not in set(got)][:2]}"
    if got != want:
        mine, theirs = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
        return f"{len(mine)} of {len(got)} rows differ ({cols}): {mine[:2]} vs {theirs[:2]}"
    types = {type(v) for row in got for v in row}
    return ""
