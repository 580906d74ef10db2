"""Run registered queries on Spark and their SQL twins on DuckDB; compare
row count, column names and order-insensitive values.

usage: python tools/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from verdigris.plans import logical as L  # noqa: E402
from verdigris.plans.catalog import entries  # noqa: E402
from verdigris.session import get_spark  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral_value() else str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return norm(v.item())
        if isinstance(v, np.ndarray):
            return tuple(norm(x) for x in v.tolist())
    except ImportError:
        pass
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    spark = get_spark("local[8]", 8)
    if os.environ.get("ORACLE_TZ"):          # run under a non-UTC session zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_TZ"])
    con = duckdb.connect()
    for t in L.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = bad = skipped = 0
    for name, e in sorted(entries().items()):
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            sdf = e.build(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark error {type(ex).__name__}: {str(ex)[:400]}")
            continue
        ts = time.time() - t0
        if not e.sql:
            skipped += 1
            print(f"rows  {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            cur = con.execute(e.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb error {str(ex)[:400]}")
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"cols spark={sorted(scols)} duck={sorted(dcols)}")
        if len(srows) != len(drows):
            problems.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not problems:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                problems.append(f"values differ, e.g. {diff}")
        if len(srows) == 0:
            problems.append("EMPTY result")
        if problems:
            bad += 1
            print(f"FAIL  {name}: {'; '.join(problems)}")
        else:
            ok += 1
            print(f"ok    {name}: {len(srows)} rows ({ts:.1f}s)")
    print(f"== {ok} ok, {bad} failed, {skipped} rows-only")


if __name__ == "__main__":
    try:
        main()
    except Exception:
        traceback.print_exc()
        sys.exit(1)
