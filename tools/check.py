"""Run registered queries on Spark and their SQL on DuckDB; report differences.

usage: python tools/check.py [--sf 0.01] [--explain] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tallyvane.catalog.registry import load_all  # noqa: E402
from tallyvane.session import local_session  # noqa: E402
from tallyvane.sources.tables import TABLES  # noqa: E402


def norm(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    directory = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    bad = 0
    for name, q in load_all().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            df = q.run(spark, directory)
            if args.explain:
                df.explain("formatted")
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            types = dict(df.dtypes)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {str(exc)[:1500]}", flush=True)
            continue
        took = time.time() - start
        nested = [c for c, t in types.items() if t.startswith(("array", "map", "struct", "variant"))]
        if nested:
            print(f"NOTE  {name}: nested output {nested}")
        if q.sql is None:
            print(f"rows  {name}: {len(got)} rows, {took:.2f}s (no sql)", flush=True)
            continue
        try:
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = rows_of(cols, cur.fetchall())
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb {str(exc)[:1500]}", flush=True)
            continue
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(df.columns)} vs {sorted(cols)}", flush=True)
        elif got == want:
            print(f"ok    {name}: {len(got)} rows, {took:.2f}s", flush=True)
        else:
            bad += 1
            diffs = [(a, b) for a, b in zip(got, want) if a != b]
            print(f"FAIL  {name}: {len(got)} vs {len(want)} rows, {len(diffs)} differ; cols {sorted(cols)}")
            for a, b in diffs[:3]:
                print("   spark", str(a)[:600])
                print("   duck ", str(b)[:600])
            sys.stdout.flush()
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
