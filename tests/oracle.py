"""Runs a query and its SQL on the same tables and compares names, types and values, whatever the order of rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if hasattr(x, "normalize") and hasattr(x, "as_tuple"):
        return float(x)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    out = con.execute(sql)
    have = [d[0] for d in out.description]
    order = sorted(range(len(have)), key=lambda i: have[i])
    return [have[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    (a, x), (b, y) = spark_rows(df), duck_rows(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if x == y:
        return ""
    return f"{sum(x.values())} and {sum(y.values())} rows; only Spark: {list((x - y).items())[:3]}; only SQL: {list((y - x).items())[:3]} of {a}"
