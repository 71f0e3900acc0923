"""Hold registered queries against their SQL in DuckDB: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.10g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows in any order."""
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    began = time.time()
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    middle = time.time()
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return f"columns {columns} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    print(f"{name}: {len(got)} rows, Spark {middle - began:.1f} s, DuckDB {time.time() - middle:.1f} s", flush=True)
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} and {len(want)} rows; only in Spark {sorted(a - b)[:3]}, only in SQL {sorted(b - a)[:3]}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or sorted(oracle):
        try:
            why = compare(spark, sf_dir, name, queries[name], oracle[name])
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        if why:
            bad += 1
            print(f"DIFFERS {name}: {why}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
