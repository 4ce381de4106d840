"""Compare registered queries with their DuckDB text; print time and verdict.

usage: python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.catalog import all_entries  # noqa: E402
from plumbline.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return repr(value)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    entries = all_entries()
    picked = [n for n in entries if not args.names or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in args.names)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = []
    for name in picked:
        build, sql = entries[name]
        try:
            start = time.time()
            df = build(spark, sf_dir)
            cols = sorted(df.columns)
            got = [tuple(r[c] for c in cols) for r in df.collect()]
            spent = time.time() - start
            if sql is None:
                print(f"ROWS  {name}: {len(got)} rows {spent:.1f}s", flush=True)
                continue
            start = time.time()
            rel = con.sql(sql)
            types = dict(zip(rel.columns, [str(t) for t in rel.types]))
            expected = con.sql(f"SELECT {', '.join(chr(34)+c+chr(34) for c in sorted(types))} FROM ({sql})").fetchall()
            spent_sql = time.time() - start
            problems = []
            if sorted(types) != cols:
                problems.append(f"columns spark={cols} sql={sorted(types)}")
            else:
                for field in df.schema.fields:
                    want = SPARK_TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
                    if types[field.name] != want:
                        problems.append(f"type {field.name}: spark {want} sql {types[field.name]}")
                a = sorted(tuple(norm(v) for v in row) for row in got)
                b = sorted(tuple(norm(v) for v in row) for row in expected)
                if a != b:
                    sa, sb = set(a), set(b)
                    problems.append(f"values differ: spark {len(a)} sql {len(b)} rows; only spark {sorted(sa - sb)[:3]} only sql {sorted(sb - sa)[:3]}")
                if not a:
                    problems.append("EMPTY result")
            verdict = "OK   " if not problems else "FAIL "
            print(f"{verdict} {name}: {len(got)} rows spark {spent:.1f}s sql {spent_sql:.1f}s {'; '.join(problems)[:1500]}", flush=True)
            if problems:
                bad.append(name)
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            text = str(error).split("JVM stacktrace")[0]
            print(f"ERROR {name}: {text[:900]}", flush=True)
            if not isinstance(error, duckdb.Error) and "--tb" in sys.argv:
                traceback.print_exc()
    print(f"checked {len(picked)}, bad {len(bad)}: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
