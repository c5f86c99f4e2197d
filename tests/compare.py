"""Runs a query and its SQL over the same tables and compares rows, whatever their order."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    a, b = spark_rows(df), sql_rows(con, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows against {len(b[1])}: {[x for x in a[1] if x not in set(b[1])][:2]} against {[x for x in b[1] if x not in set(a[1])][:2]}"
    for x, y in zip(a[1], b[1], strict=True):
        if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-6) for p, q in zip(x, y, strict=True)):
            return f"{str(x)[:600]} against {str(y)[:600]}"
    return None
