"""Compares registered queries with their SQL on the given tables: python tests/compare.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value in a form that both engines share; floats keep nine digits."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return str(value)


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    names = list(got.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.select(*[df[c] for c in names]).collect())


def main(args: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, f in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            names, mine = rows_of_spark(f(spark, sf))
            sql = e.oracle_sql().get(name)
            if sql is None:
                print(f"{name}: {sum(mine.values())} rows, no SQL, {time.time() - began:.1f} s")
                continue
            theirs_names, theirs = rows_of_sql(sql, sf)
            same = names == theirs_names and mine == theirs
            print(f"{name}: {'same' if same else 'DIFFERENT'}, {sum(mine.values())} rows, {time.time() - began:.1f} s")
            if not same:
                bad += 1
                print("  ", names, theirs_names, *list((mine - theirs).items())[:3], "|", *list((theirs - mine).items())[:3])
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {str(x)[:600]}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
