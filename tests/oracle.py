"""Compare registered queries with their SQL on DuckDB: `python tests/oracle.py --sf 0.01 [names]`."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from vaneflow.session import SCHEMAS

FAMILIES = {"int": "integer", "bigint": "integer", "HUGEINT": "HUGEINT", "BIGINT": "integer", "INTEGER": "integer",
            "double": "double", "DOUBLE": "double", "FLOAT": "float", "float": "float", "string": "text", "VARCHAR": "text",
            "boolean": "bool", "BOOLEAN": "bool"}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("", None)
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, float) and v == 0:
        return ("n", repr(0.0))
    return ("n", repr(v)) if isinstance(v, (int, float)) else ("s", str(v))


def compare(spark_df, con, sql: str, rows=None) -> list[str]:
    """Differences between the Spark rows and the SQL rows; empty when they agree exactly."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    problems = []
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    for n, k in spark_df.dtypes:
        if FAMILIES.get(k, k) != FAMILIES.get(kinds[n], kinds[n]):
            problems.append(f"type of {n}: {k} vs {kinds[n]}")
    order = sorted(names)
    got = sorted(tuple(_norm(r[c]) for c in order) for r in (spark_df.collect() if rows is None else rows))
    pos = [names.index(c) for c in order]
    want = sorted(tuple(_norm(r[i]) for i in pos) for r in expected)
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. {order}\n   got  {bad[0][0]}\n   want {bad[0][1]}")
    if not got:
        problems.append("no rows")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module", default=None)
    parser.add_argument("--dir", default=None, help="a folder of tables instead of a scale factor")
    args = parser.parse_args()
    from vaneflow.catalog import load
    from vaneflow.catalog.registry import BUILDERS, ORACLES, runnable
    from vaneflow.session import build_session

    load()
    spark = build_session()
    sf_dir = args.dir or f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    failed = 0
    for name in args.names or BUILDERS:
        if args.module and not BUILDERS[name].__module__.endswith(args.module):
            continue
        start = sql_time = time.time()
        try:
            df = runnable(name)(spark, sf_dir)
            if name in ORACLES:
                rows = df.collect()
                sql_time = time.time()
                problems = compare(df, con, ORACLES[name], rows)
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            text = str(e)
            problems = [f"{type(e).__name__}: {text[:500]}", *[ln[:300] for ln in text.splitlines() if ln.startswith("Caused by")]]
        failed += bool(problems)
        note = "" if name in ORACLES else " (rows only)"
        spent = f"{sql_time - start:6.2f}s sql {time.time() - sql_time:5.2f}s"
        print(f"{'FAIL' if problems else 'ok  '} {spent} {name}{note}", *problems, sep="\n     ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
