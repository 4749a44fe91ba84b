"""Run a registered query and its SQL check side by side."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

from palimpsest.plans.catalog import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str, clock: list | None = None) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty if equal."""
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if clock is not None:
        clock.append(time.time())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    duck_rows = rows_of(names, cur.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} / {sorted(names)}")
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if name in kinds and same.get(kind, kind) != kinds[name]:
            out.append(f"type of {name}: {kind} / {kinds[name]}")
    if len(spark_rows) != len(duck_rows):
        out.append(f"rows {len(spark_rows)} / {len(duck_rows)}")
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if bad:
        out.append(f"{len(bad)} values differ, first {str(bad[0][0])[:400]} / {str(bad[0][1])[:400]}")
    return out
