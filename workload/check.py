"""Run every query and its SQL side by side: ``python -m workload.check [sf_dir] [query ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from tablescope.session import configure
from workload import catalog, flaws  # noqa: F401 - flaws adds its queries to the catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and not math.isnan(value):
        return float(f"{value:.9g}")
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """Empty if both sides agree, else what differs."""
    df = catalog.QUERIES[name](spark, sf_dir)
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLES:
        return "" if got[1] else "no rows"
    result = con.execute(catalog.ORACLES[name])
    expected = _table([c[0] for c in result.description], result.fetchall())
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return f"{len(got[1])} rows != {len(expected[1])}"
    for a, b in zip(got[1], expected[1]):
        if a != b:
            return f"{str(a)[:300]} != {str(b)[:300]}"
    return ""


def main(sf_dir: str, names) -> int:
    spark = configure(SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
                      .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or catalog.QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '}{time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
