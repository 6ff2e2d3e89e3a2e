"""Compare column types of registered queries with their SQL counterparts.

    python tests/type_check.py [--sf 0.001]
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from parity import oracle_connection  # noqa: E402


def spark_family(t: str) -> str:
    if t in ("int", "bigint", "smallint", "tinyint"):
        return "int"
    if t in ("double", "float"):
        return "float"
    return {"string": "text", "boolean": "bool"}.get(t, t)


def duck_family(t: str) -> str:
    t = t.upper()
    if t in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT", "UINTEGER", "UBIGINT"):
        return "int"
    if t in ("DOUBLE", "FLOAT"):
        return "float"
    return {"VARCHAR": "text", "BOOLEAN": "bool"}.get(t, t)


def main() -> int:
    import __spark_entry__ as entry

    from kpiscope.session import build_session

    sf_dir = "/root/testdata/sf0.001"
    spark = build_session("types", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    bad = 0
    queries = entry.queries()
    for name, sql in entry.oracle_sql().items():
        mine = {c: spark_family(t) for c, t in queries[name](spark, sf_dir).dtypes}
        rel = con.execute(f"DESCRIBE {sql}").fetchall()
        theirs = {r[0]: duck_family(r[1]) for r in rel}
        diff = {c: (mine.get(c), theirs.get(c)) for c in sorted(set(mine) | set(theirs)) if mine.get(c) != theirs.get(c)}
        if diff:
            bad += 1
            print(name, diff, flush=True)
    print(f"mismatching queries: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
