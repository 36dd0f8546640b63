"""Run queries on Spark and DuckDB and compare whole results.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from tracesieve.session import build_session
from workload import catalog
from workload.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("n", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, int):
        return ("n", repr(float(value)))
    return ("s", value if value is None else str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    """``("ok" | what differs, number of rows)``."""
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    columns, rows = rows_of(df.columns, df.collect())
    compare.spark_seconds = time.time() - start
    if name not in catalog.ORACLES:
        return "rows only", len(rows)
    cursor = con.execute(catalog.ORACLES[name])
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if columns != want_columns:
        return f"columns {columns} against {want_columns}", len(rows)
    if len(rows) != len(want):
        return f"{len(rows)} rows against {len(want)}", len(rows)
    for got, expected in zip(rows, want):
        if got != expected:
            diff = [(c, g, e) for c, g, e in zip(columns, got, expected) if g != e]
            return f"values {str(diff)[:700]}", len(rows)
    return "ok", len(rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in args.names or list(catalog.QUERIES):
        start = time.time()
        try:
            outcome, n = compare(spark, con, args.sf, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            outcome, n = f"ERROR {type(error).__name__}: {str(error)[:900]}", 0
        bad += outcome not in ("ok", "rows only")
        print(f"{name:28} {n:8} rows {time.time() - start:6.2f}s  spark {getattr(compare, "spark_seconds", 0):6.2f}s  {outcome}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
