"""Compare a query's rows with its SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

ROOT = os.environ.get("TESTDATA_ROOT", "/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def difference(spark, con, folder: str, fn, sql: str) -> str | None:
    """None when equal, else a short description."""
    df = fn(spark, folder)
    ours = rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if ours != theirs:
        extra, missing = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"{sum(ours.values())} vs {sum(theirs.values())} rows; only ours {extra}; only SQL {missing}"
    return None
