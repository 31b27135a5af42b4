"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py [sf] [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, int):
        return float(v)
    return str(v)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = fn(spark, sf_dir)
    mine = _sorted(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = _sorted(rel.columns, rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}"
    if not mine[1]:
        return "no rows" if name != "lookup_id" else None
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{a} against {b}"
    return None


def main() -> int:
    from logloom.session import build_session

    sf_dir = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    wanted = sys.argv[2:]
    import __spark_entry__ as entry

    spark = build_session(
        "oracle-check", "local[8]", 8,
        {"spark.ui.enabled": "false", "spark.driver.memory": "8g",
         "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, fn, sqls[name], sf_dir)
                kind = "ok"
            else:
                n = len(fn(spark, sf_dir).collect())
                problem, kind = (None, f"{n} rows, no SQL")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:34s} {time.time() - start:6.2f}s  {kind if problem is None else 'DIFFERS ' + problem}")
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
