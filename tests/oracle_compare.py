"""Spark-vs-DuckDB comparison of registered queries (row count, column names and an
order-insensitive comparison of values)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (not isinstance(x, (list, dict, str)) and pd.isna(x)) else x)
                         for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(sp), sec=round(t1 - t0, 2), note="rows-only")
    dd = con.execute(sql).fetchdf()
    res = dict(name=name, rows=len(sp), oracle_rows=len(dd), sec=round(t1 - t0, 2))
    if sorted(sp.columns) != sorted(dd.columns):
        res.update(ok=False, note=f"columns {sorted(sp.columns)} vs {sorted(dd.columns)}")
        return res
    a, b = rows_of(sp), rows_of(dd)
    if a == b:
        res["ok"] = True
    else:
        diff_a = [r for r in a if r not in set(b)][:3] if len(a) < 200000 else a[:2]
        diff_b = [r for r in b if r not in set(a)][:3] if len(b) < 200000 else b[:2]
        res.update(ok=False, note=f"spark-only {str(diff_a)[:600]} | oracle-only {str(diff_b)[:600]}")
    return res


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from credline.plans.queries import ORACLE, QUERIES
    from credline.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]")
    con = duck(sf_dir)
    bad = 0
    for name in only:
        try:
            r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, ok=False, note=f"ERROR {type(e).__name__}: {str(e)[:800]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED", bad)
