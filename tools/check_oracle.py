"""Run registered queries and their SQL side by side and compare rows.

    python tools/check_oracle.py [--sf DIR] [--slow SECONDS] [name prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from sparksymbols.plans import ORACLE_SQL, QUERIES
from sparksymbols.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def cell(x: object) -> str:
    if isinstance(x, float):
        return "null" if x != x else f"{x:.9g}"
    if x is None or x is pd.NaT or x is pd.NA:
        return "null"
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    return str(x)


def normal(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]) and df[c].dropna().mod(1).eq(0).all() and df[c].isna().any():
            df = df.assign(**{c: df[c].astype("Int64")})
    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


def compare(name: str, spark, con, folder: str) -> tuple[str, float]:
    started = time.time()
    got = QUERIES[name](spark, folder).toPandas()
    seconds = time.time() - started
    if name not in ORACLE_SQL:
        return f"rows only: {len(got)}", seconds
    want = con.execute(ORACLE_SQL[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} <> {sorted(want.columns)}", seconds
    a, b = normal(got), normal(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"DIFFERENT {len(a)} rows, oracle {len(b)}\n   spark  {only_a}\n   oracle {only_b}", seconds
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype}
    return f"ok {len(a)} rows" + (f" (types {kinds})" if kinds else ""), seconds


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(args.sf)
    bad = 0
    for name in QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            result, seconds = compare(name, spark, con, args.sf)
        except Exception as e:
            result, seconds = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0
        bad += not result.startswith(("ok", "rows only"))
        print(f"{name:28} {seconds:6.2f}s  {result}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
