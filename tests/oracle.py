"""Spark results against DuckDB's, row by row."""

from __future__ import annotations

import math
from pathlib import Path

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((x is not None, str(type(x).__name__), x if not isinstance(x, bool) else int(x)) if not isinstance(x, (int, float)) or isinstance(x, bool) else (True, "number", x) for x in t))


def differences(df, sql: str, con) -> list[str]:
    """What differs: columns, number of rows, or the first few rows."""
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if len(mine) != len(theirs):
        return [f"{len(mine)} and {len(theirs)} rows"]
    off = [f"{a} and {b}" for a, b in zip(mine, theirs, strict=True) if a != b]
    return off[:5] + ([f"{len(off)} of {len(mine)} rows differ"] if off else [])
