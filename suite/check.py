"""Compare the registered queries with their SQL: ``python -m suite.check [sf_dir] [name…]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from corpusfreq.session import drop_stored
from suite import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    mine = normal(df.collect(), df.columns)
    took = time.time() - start
    if name not in ORACLE:
        return f"rows only ({len(mine)})", took
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    theirs = normal(rel.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", took
    if len(mine) != len(theirs):
        return f"ROWS {len(mine)} != {len(theirs)}", took
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"VALUES {len(bad)} of {len(mine)} differ, e.g. {bad[0]}", took
    return f"ok ({len(mine)} rows)", took


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args[1:] or any(n.startswith(a) for a in args[1:])]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='corpusfreq-check-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in names:
        try:
            result, took = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            result, took = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0
        drop_stored(spark)
        good = result.startswith(("ok", "rows only"))
        failed += not good
        print(f"{'   ' if good else '!! '}{name:32s} {took:6.1f}s  {result}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
