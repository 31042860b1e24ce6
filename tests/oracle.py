"""Runs a query and its oracle SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(spark, con, folder: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, folder)
    got_cols = sorted(df.columns)
    got = Counter(tuple(normal(r[c]) for c in got_cols) for r in df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    order = [cols.index(c) for c in sorted(cols)]
    want = Counter(tuple(normal(r[i]) for i in order) for r in rel.fetchall())
    if got_cols != sorted(cols):
        return f"columns {got_cols} against {sorted(cols)}"
    if got != want:
        return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return ""
