"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows."""

import datetime
import decimal
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if isinstance(x, bytearray):
        return bytes(x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(spark, f, at):
    df = f(spark, at)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sql, at):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    r = con.sql(sql)
    return rows_of(r.columns, r.fetchall())


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    at, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master(os.environ.get("ORACLE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sql = e.oracle_sql()
    for n, f in e.queries().items():
        if names and not any(n.startswith(x) for x in names):
            continue
        t = time.time()
        try:
            a = spark_rows(spark, f, at)
            b = duck_rows(sql[n], at) if n in sql else a
            same = a == b
            print("ok " if same else "BAD", n, len(a[1]), len(b[1]), f"{time.time() - t:.1f}s", "" if n in sql else "(no SQL)", flush=True)
            if not same:
                print("   ", a[0], b[0])
                for x in [r for r in a[1] if r not in set(b[1])][:2]:
                    print("    spark", x)
                for x in [r for r in b[1] if r not in set(a[1])][:2]:
                    print("    duck ", x)
        except Exception as x:  # noqa: BLE001
            print("ERR", n, str(x)[:600].replace("\n", " | "), flush=True)
