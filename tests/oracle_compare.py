"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: rows, schema and value match.  Set PLAIN_SESSION=1 to
run under a default SparkSession (no Arrow, 200 shuffle partitions) instead of
``casediff.session.local_session``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from casediff.session import local_session  # noqa: E402
from casediff.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .getOrCreate())
    else:
        spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            got = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:34s} rows={len(got):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            exp = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} SQL-ERROR {str(e)[:300]}")
            bad += 1
            continue
        gc, gr = canon(got)
        ec, er = canon(exp)
        ok = gc == ec and gr == er
        bad += not ok
        detail = ""
        if gc != ec:
            detail = f" cols {gc} vs {ec}"
        elif gr != er:
            diff = [(a, b) for a, b in zip(gr, er) if a != b][:3]
            detail = f" first diffs {diff}"
        print(f"{name:34s} rows={len(got):7d}/{len(exp):7d} {'OK ' if ok else 'BAD'} {ts:.1f}s{detail}")
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
