"""Run a registered query in Spark and its oracle SQL in DuckDB, compare.

Mirrors the driver's check: same row count, same column names, and the same
multiset of rows after sorting columns by name. Values are compared exactly
(floats too); ``tol`` relaxes floats for diagnosis only.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tillroll.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=_key)


def compare(spark_df, con, sql, tol: float = 0.0):
    sc, sr = spark_rows(spark_df)
    dc, dr = duck_rows(con, sql)
    problems = []
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duck={dc}")
        return problems
    if len(sr) != len(dr):
        problems.append(f"row count differs: spark={len(sr)} duck={len(dr)}")
    bad = 0
    for a, b in zip(sr, dr):
        if a != b:
            if tol and all(
                (x == y) or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tol * max(1, abs(x)))
                for x, y in zip(a, b)
            ):
                continue
            bad += 1
            if bad <= 3:
                problems.append(f"row differs: spark={a} duck={b}")
    if bad:
        problems.append(f"{bad} differing rows")
    return problems
