"""Run registered queries beside their DuckDB oracles: python tests/oracle.py [sf] [query or module ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows: list[dict]) -> list[tuple]:
    """Rows as tuples of (column, value) in a fixed order, independent of row and column order."""
    out = [tuple((k, r[k]) for k in sorted(r)) for r in rows]
    return sorted(out, key=repr)


def same(a, b, tolerance: float = 0.0) -> bool:
    if isinstance(a, float) and isinstance(b, float) and tolerance:
        return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    return a == b and (type(a) is type(b) or not isinstance(a, (bool, float)))


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs first."""
    got = [r.asDict(recursive=True) for r in df.collect()]
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(normal(got), normal(want)):
        for (k, x), (_, y) in zip(g, w):
            if not same(x, y):
                close = same(x, y, 1e-6) if isinstance(x, float) else False
                return f"{k}: {x!r} != {y!r}{' (close)' if close else ''}\n   {dict(g)}\n   {dict(w)}"
    return None


def main() -> None:
    from assay.session import local_session
    from assay.plans.catalog import MODULES, ORACLE, QUERIES
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    names = [n for n in args[1:] if n in QUERIES]
    for module in MODULES:
        if module.__name__.rsplit(".", 1)[1] in args[1:]:
            names += list(module.QUERIES)
    names = names or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                problem = compare(df, con, ORACLE[name])
                kind = "oracle"
            else:
                n = len(df.collect())
                problem, kind = (None if n else "no rows"), f"{n} rows"
        except Exception as e:  # keep going: the report lists every failure
            problem, kind = f"{type(e).__name__}: {str(e)[:1500]}", "error"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.2f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad}/{len(names)} good")


if __name__ == "__main__":
    main()
