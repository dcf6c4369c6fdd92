"""Run registered queries beside their DuckDB oracles and compare the answers.

    python check_oracles.py [--sf DIR] [--times] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time

import duckdb

from tidemark.session import build_session
from tidemark.staging import release
from workload import all_cases

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--zone", default="UTC")
    args = parser.parse_args()
    # One machine checks itself here, so its own temporary folder serves as the shared one.
    spark = build_session("check", "local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="checks-"), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": args.zone})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{args.sf}/{table}.parquet'")
    bad = []
    for name, item in sorted(all_cases().items()):
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        started = time.time()
        try:
            df = item.spark(spark, args.sf)
            kinds = dict(df.dtypes)
            columns = sorted(df.columns)
            got = [tuple(normal(row[c]) for c in columns) for row in df.collect()]
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        spent = time.time() - started
        sql = item.oracle()
        if sql is None:
            print(f"rows  {name}: {len(got)} rows {spent:.1f}s", flush=True)
            continue
        try:
            started = time.time()
            cursor = con.execute(sql)
            names = [d[0] for d in cursor.description]
            types = {d[0]: str(d[1]).upper() for d in cursor.description}
            want = [tuple(normal(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"ORACLE ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        key = lambda row: tuple((v is None, str(v)) for v in row)
        got.sort(key=key)
        want.sort(key=key)
        wrong_types = {c: (kinds[c], types.get(c)) for c in columns if KINDS.get(kinds[c]) not in types.get(c, "")}
        if sorted(names) != columns or got != want or wrong_types:
            bad.append(name)
            print(f"DIFF  {name}: spark {len(got)} oracle {len(want)} types {wrong_types}", flush=True)
            extra, lacking = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
            print("   columns", columns)
            for r in extra[:4]:
                print("   spark only ", r)
            for r in lacking[:4]:
                print("   oracle only", r)
        else:
            print(f"ok    {name}: {len(got)} rows spark {spent:.1f}s oracle {time.time() - started:.1f}s", flush=True)
    release(spark)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
