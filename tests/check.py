"""Compares registered queries with their SQL: python -m tests.check [sf] [name ...]"""

import datetime as dt
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def main():
    from __spark_entry__ import oracle_sql, queries

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.001"), sys.argv[2:]
    sf_dir = f"{ROOT}/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001 - a report over all queries
            print(f"ERROR {name}: {str(e)[:600]}", flush=True)
            continue
        spent = time.time() - t
        if name not in known:
            print(f"rows  {name} {len(got[1])} {spent:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            want = oracle_rows(known[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            print(f"SQL   {name}: {str(e)[:600]}", flush=True)
            continue
        same = got == want
        print(f"{'ok   ' if same else 'DIFF '} {name} {len(got[1])}/{len(want[1])} {spent:.1f}s sql {time.time() - t:.1f}s", flush=True)
        if not same:
            print("   ", got[0], want[0])
            a, b = set(got[1]), set(want[1])
            print("    spark only", sorted(a - b)[:3], "\n    sql only", sorted(b - a)[:3], flush=True)


if __name__ == "__main__":
    main()
