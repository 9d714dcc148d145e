"""Spark-vs-DuckDB comparison of the registered queries (row count, column
names, order-insensitive values), used by the tests and runnable alone:

    python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "asDict"):
        return str(v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"key": name, "rows": len(srows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    res["oracle_rows"] = len(drows)
    if sorted(cols) != sorted(dcols):
        res["status"] = f"columns differ: spark={sorted(cols)} oracle={sorted(dcols)}"
        return res
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s = sorted((tuple(_norm(r[i]) for i in si) for r in srows), key=_key)
    d = sorted((tuple(_norm(r[i]) for i in di) for r in drows), key=_key)
    if len(s) != len(d):
        res["status"] = "row count differs"
    elif s != d:
        bad = next(k for k in range(len(s)) if s[k] != d[k])
        res["status"] = f"values differ at {bad}: spark={s[bad]} oracle={d[bad]}"
    else:
        res["status"] = "ok"
    return res


def main(argv):
    from kolekta.session import build_session
    import __spark_entry__ as entry
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or sorted(entry.queries())
    spark = build_session("local[8]", 8)
    con = duck(sf)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, sf, k, q[k], o.get(k))
        except Exception as e:  # report and keep going
            r = {"key": k, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
