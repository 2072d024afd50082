"""Run a registered query and its SQL twin and compare rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{os.path.join(folder, name)}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(spark, con, name: str, query, sql: str | None, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, folder)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "the plan pairs all rows with all rows"
    if sql is None:
        return None if df.columns else "no columns"
    cur = con.execute(sql)
    names, want = _sorted([d[0] for d in cur.description], cur.fetchall())
    have_names, have = _sorted(df.columns, rows)
    if names != have_names:
        return f"columns {have_names} != {names}"
    if len(have) != len(want):
        return f"{len(have)} rows != {len(want)}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    return f"{len(bad)} of {len(want)} rows differ, e.g. {bad[0]}" if bad else None
