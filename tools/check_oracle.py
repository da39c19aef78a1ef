"""Run queries on Spark and their SQL on DuckDB, and compare the rows.

    python tools/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from gleanframe.plans import ORACLES, QUERIES, load_all  # noqa: E402
from gleanframe.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--plain", action="store_true", help="use a session with default settings")
    args.add_argument("names", nargs="*")
    args = args.parse_args()
    load_all()
    names = args.names or list(QUERIES)
    spark = local_session(8) if not args.plain else SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in ORACLES:
                print(f"ROWS {name} rows={len(got)} {took:.1f}s cols={df.columns}", flush=True)
                if len(got) <= 12 or args.names:
                    for r in got[:12]:
                        print("    ", r)
                continue
            start = time.time()
            res = duck.execute(ORACLES[name])
            cols = [d[0] for d in res.description]
            want = res.fetchall()
            duck_took = time.time() - start
            types = [str(d[1]) for d in res.description]
            huge = [c for c, t in zip(cols, types) if "HUGEINT" in t or "DECIMAL" in t]
            if sorted(cols) != sorted(df.columns):
                bad += 1
                print(f"FAIL {name}: columns {sorted(df.columns)} != {sorted(cols)}")
                continue
            a, b = canonical(got, df.columns), canonical(want, cols)
            if a == b and got:
                print(f"ok   {name} rows={len(a)} spark={took:.1f}s duck={duck_took:.1f}s {'TYPES ' + str(huge) if huge else ''}", flush=True)
            else:
                bad += 1
                print(f"FAIL {name}: {len(a)} vs {len(b)} rows; columns {sorted(cols)}")
                sa, sb = set(a), set(b)
                for r in sorted(sa - sb)[:4]:
                    print("   spark", r)
                for r in sorted(sb - sa)[:4]:
                    print("   duck ", r)
        except Exception as e:
            bad += 1
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:1500]}")
            if args.names:
                traceback.print_exc()
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
