"""Runs a query and its SQL side by side: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return "true" if value else "false"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None when both give the same columns and the same rows in any order."""
    ours = df.collect()
    rel = con.execute(sql)
    theirs = rel.fetchall()
    names = [c[0] for c in rel.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = table_rows(df.columns, ours), table_rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sum(p != q for p, q in zip(a, b))} rows differ, first: {x} != {y}"
    return None


def main():
    from vidspark.plans import registry
    from vidspark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    queries, oracles = registry.load_all()
    spark = build_session(master="local[8]", cores=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = queries[name](spark, d)
            if name in oracles:
                result = difference(df, con, oracles[name])
                note = "ok" if result is None else "DIFF " + result[:600]
            else:
                note = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            note = "FAIL " + str(e)[:700]
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
