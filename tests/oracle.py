"""Side-by-side check of registered queries against their SQL oracle in DuckDB.

    python tests/oracle.py [sf] [query ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8; SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅" if v is None else "NaN"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def compare(spark, con, query, sf_dir):
    """Return (ok, message, spark seconds)."""
    t0 = time.time()
    df = query.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - t0
    if query.oracle is None:
        return len(rows) > 0, f"rows={len(rows)} (no oracle)", seconds
    cur = con.execute(query.oracle)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", seconds
    order = sorted(names)
    a = sorted(tuple(_cell(r[df.columns.index(n)]) for n in order) for r in rows)
    b = sorted(tuple(_cell(r[names.index(n)]) for n in order) for r in other)
    if a != b:
        left, right = [x for x in a if x not in set(b)][:4], [x for x in b if x not in set(a)][:4]
        return False, f"rows {len(a)} vs {len(b)}\n  order {order}\n  spark {left}\n  duck  {right}", seconds
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    odd = [f"{n}:{t}/{kinds[n]}" for n, t in df.dtypes
           if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t, "?") not in kinds[n].upper()
           and not (t == "string" and "STRING" in kinds[n].upper()) and not (t in ("bigint", "double", "int", "boolean") and "NUMBER" in kinds[n].upper())]
    return True, f"rows={len(a)}" + (f" TYPES {odd}" if odd else ""), seconds


def main():
    from tracksieve.plans.registry import all_queries
    from tracksieve.session import get_session

    args = sys.argv[1:]
    sf = args.pop(0) if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries = all_queries()
    names = [n for n in queries if not args or n in args or any(a.endswith("*") and n.startswith(a[:-1]) for a in args)]
    spark = get_session("oracle", "8")
    con = duck(sf_dir)
    bad = []
    for n in names:
        try:
            ok, message, seconds = compare(spark, con, queries[n], sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, message, seconds = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {n} {seconds:.2f}s {message}", flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
