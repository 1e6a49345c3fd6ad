"""Run registered queries beside their SQL on DuckDB and compare the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


def normal(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in data)


def compare(spark, con, name, query, sql, sf_dir):
    """None where the rows agree, else a text that says how they differ."""
    frame = query(spark, sf_dir)
    got = [tuple(row) for row in frame.collect()]
    if sql is None:
        return None if got else "no rows"
    result = con.sql(sql)
    want = result.fetchall()
    if sorted(frame.columns) != sorted(result.columns):
        return f"columns {sorted(frame.columns)} != {sorted(result.columns)}"
    types = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    spark_types = {c: types.get(t, t) for c, t in frame.dtypes}
    duck_types = dict(zip(result.columns, [str(t) for t in result.types]))
    if spark_types != duck_types:
        return f"types {[(c, t, duck_types[c]) for c, t in spark_types.items() if t != duck_types[c]]}"
    a, b = normal(frame.columns, got), normal(result.columns, want)
    if a == b:
        return None if a else "no rows"
    only_spark, only_sql = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} rows, SQL {len(b)}; only Spark ({len(only_spark)}): {only_spark[:2]}; only SQL ({len(only_sql)}): {only_sql[:2]}"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--zone", default="UTC")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries

    from dbgauge.session import build_session

    spark = build_session("compare", master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.conf.set("spark.sql.session.timeZone", args.zone)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    bad = 0
    for name, query in queries().items():
        if args.names and name not in args.names:
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, query, oracle_sql().get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {str(problem or '')[:2500]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
