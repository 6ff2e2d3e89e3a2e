"""Compare registered queries with their SQL counterparts on DuckDB.

    python tests/parity.py [--sf 0.001] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 7)
    if hasattr(value, "__float__") and not isinstance(value, (int, str)):
        return round(float(value), 7)
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return str(value)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    spent = time.time() - start
    cols, mine = rows_of(df.columns, [tuple(r) for r in got])
    if sql is None:
        return "rows-only", len(mine), spent, ""
    cur = con.execute(sql)
    ocols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return "SCHEMA", len(mine), spent, f"{cols} vs {ocols}"
    if len(mine) != len(theirs):
        a, b = set(mine), set(theirs)
        return "COUNT", len(mine), spent, f"{len(mine)} vs {len(theirs)}\n   +{list(a-b)[:3]}\n   -{list(b-a)[:3]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return "VALUES", len(mine), spent, f"{len(bad)} differ\n   " + "\n   ".join(f"{cols}\n   {a}\n   {b}" for a, b in bad[:2])
    return "ok", len(mine), spent, ""


def main() -> int:
    import __spark_entry__ as entry

    from kpiscope.session import build_session

    args = sys.argv[1:]
    sf = "0.001"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("parity", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracles = entry.oracle_sql()
    failures, total = 0, 0.0
    for name, fn in entry.queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            status, n, spent, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # report and carry on
            status, n, spent, note = "ERROR", 0, 0.0, str(exc)[:900]
        total += spent
        if status not in ("ok", "rows-only"):
            failures += 1
        empty = "  EMPTY" if n == 0 and status in ("ok", "rows-only") else ""
        if status != "ok" or empty or spent > 4 or args:
            print(f"{status:10} {name:28} rows={n:<8} {spent:6.2f}s {empty} {note}", flush=True)
    print(f"failures={failures} spark_seconds={total:.1f}")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
