"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def make_session(cores: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("fieldseq-tests")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (round(v, 6) + 0.0)
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return str(v)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name, fn, sql, sf_dir):
    """None when equal, else a text saying what differs."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = normal(df.collect(), df.columns)
    took = time.time() - t0
    if sql is None:
        return None, len(got), took
    rel = duck(sf_dir).execute(sql)
    cols = [d[0] for d in rel.description]
    want = normal(rel.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got), took
    if got != want:
        ws, gs = set(want), set(got)
        a = [r for r in got if r not in ws][:3]
        b = [r for r in want if r not in gs][:3]
        return f"rows {len(got)} vs {len(want)}\n spark only {a}\n duck only {b}", len(got), took
    return None, len(got), took


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = make_session()
    sqls = oracle_sql()
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            diff, n, took = compare(spark, name, fn, sqls.get(name), sf)
        except Exception as e:
            diff, n, took = "ERR " + str(e)[:1500], 0, 0
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} rows={n} {took:.2f}s"
              f"{'' if sqls.get(name) else ' (no sql)'}"
              + ("" if diff is None else "\n   " + diff), flush=True)
