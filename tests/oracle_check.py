"""Run registered queries next to their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def compare(spark, con, fn, sql, root):
    """(ok, message, rows)"""
    t = time.time()
    df = fn(spark, root)
    built = time.time() - t
    rows = df.collect()
    spent = f"(plan {built:.2f}s run {time.time() - t - built:.2f}s)"
    got_cols, got = table(df.columns, rows)
    if sql is None:
        return True, "rows only", len(got)
    rel = con.execute(sql)
    want_cols, want = table([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return False, f"{len(bad)} rows differ, first {bad[0]}", len(got)
    return True, spent, len(got)


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    root = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    qs, sqls = e.queries(), e.oracle_sql()
    failed = []
    for name in argv[1:] or qs:
        t = time.time()
        try:
            ok, msg, n = compare(spark, con, qs[name], sqls.get(name), root)
        except Exception as ex:  # noqa: BLE001
            ok, msg, n = False, f"{type(ex).__name__}: {str(ex)[:600]}", -1
        print(f"{'PASS' if ok else 'FAIL'} {name} rows={n} {time.time() - t:.2f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
