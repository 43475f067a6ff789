"""Compare every registered query with its DuckDB text: python tests/oracle_check.py SF_DIR [slug ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from framekit.plans.fixtures import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("n", value)
    if isinstance(value, float):
        return ("f", round(value, 6) + 0.0)
    return ("s", str(value))


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when both sides hold the same rows, else a short account of the difference."""
    rel = con.sql(sql)
    names, types = list(rel.columns), [str(t) for t in rel.types]
    bad = [f"{n}:{t}" for n, t in zip(names, types) if t in ("HUGEINT",) or t.startswith("DECIMAL")]
    if bad:
        return f"types {bad}"
    df = fn(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    odd = [(n, t, dict(df.dtypes)[n]) for n, t in zip(names, types) if kinds.get(t) != dict(df.dtypes)[n]]
    cols = sorted(names)
    left = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    right = Counter(tuple(_norm(v) for v in row) for row in con.sql(f"SELECT {', '.join(chr(34)+c+chr(34) for c in cols)} FROM ({sql})").fetchall())
    if left != right:
        a, b = left - right, right - left
        return f"rows {sum(left.values())} vs {sum(right.values())}; cols {cols}; spark only {list(a)[:2]}; oracle only {list(b)[:2]}"
    if odd:
        return f"dtype {odd}"
    return None if left else "no rows on both sides"


def main() -> int:
    from framekit.session import build_session
    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": int(os.environ.get("FRAMEKIT_PARTITIONS", "8")), "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for slug, fn in queries.items():
        if wanted and slug not in wanted:
            continue
        start = time.time()
        try:
            if slug in oracles:
                found = difference(spark, con, fn, oracles[slug], sf_dir)
            else:
                n = fn(spark, sf_dir).count()
                found = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            found = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += found is not None
        note = "" if slug in oracles else " (no oracle)"
        print(f"{'ok  ' if found is None else 'FAIL'} {slug}{note} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
