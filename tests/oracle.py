"""Runs a query and its SQL twin and compares rows, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "as_tuple"):
        return _norm(float(v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def connect(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(directory)):
        if f.endswith(".parquet"):
            path = os.path.join(directory, f)
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(spark, directory, query, sql):
    """None if equal, else a short text on the difference."""
    df = query(spark, directory)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = connect(directory).execute(sql)
    columns = [c[0] for c in res.description]
    theirs = rows_of(columns, res.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows and {len(theirs[1])}: only here {sorted(set(mine[1]) - set(theirs[1]), key=repr)[:3]}, only there {sorted(set(theirs[1]) - set(mine[1]), key=repr)[:3]}"
    for a, b in zip(mine[1], theirs[1], strict=True):
        if a != b:
            return f"{a} and {b}"
    return None
