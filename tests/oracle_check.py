"""Runs every registered query on Spark and its oracle SQL on DuckDB and
compares row count, column names and an order-insensitive value hash.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "\x00null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x01".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = connect(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        s_rows = [tuple(r) for r in sdf.collect()]
        s_cols = sdf.columns
        t1 = time.time()
        if name not in sql:
            report[name] = {"rows": len(s_rows), "oracle": None}
            if verbose:
                print(f"{name:28s} spark={len(s_rows):7d} (no oracle) {t1 - t0:.1f}s")
            continue
        cur = con.execute(sql[name])
        d_cols = [d[0] for d in cur.description]
        d_rows = cur.fetchall()
        t2 = time.time()
        hs, ls = digest(s_cols, s_rows)
        hd, ld = digest(d_cols, d_rows)
        ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and hs == hd
        report[name] = {"rows": len(s_rows), "oracle_rows": len(d_rows), "match": ok}
        if verbose:
            print(f"{name:28s} spark={len(s_rows):7d} duck={len(d_rows):7d} "
                  f"{'OK ' if ok else 'BAD'} {t1 - t0:.1f}s/{t2 - t1:.1f}s")
            if not ok:
                if sorted(s_cols) != sorted(d_cols):
                    print("   columns", sorted(s_cols), sorted(d_cols))
                else:
                    diff_s = sorted(set(ls) - set(ld))[:2]
                    diff_d = sorted(set(ld) - set(ls))[:2]
                    print("   spark-only", [x[:300] for x in diff_s])
                    print("   duck-only ", [x[:300] for x in diff_d])
    return report


if __name__ == "__main__":
    from corpusflow.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    rep = compare(spark, sf, names)
    bad = [k for k, v in rep.items() if v.get("match") is False]
    print("BAD:", bad)
