"""Compare a query with its SQL, as sorted rows with columns by name."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return v


def connection(folder: str):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        files = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{files}'")
    c.execute("set timezone = 'UTC'")
    return c


def rows_of(df, columns):
    return sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())


def sql_rows(c, sql, columns):
    result = c.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(n) for n in columns]
    return sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())
