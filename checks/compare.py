"""Run queries and oracle SQL side by side: python -m checks.compare [sf_dir] [key ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLE, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple((type(v).__name__, plain(v)) if v is not None else ("", "")
                         for v in (row[i] for i in order)) for row in rows), key=repr)


def oracle_rows(db, key: str):
    cursor = db.execute(ORACLE[key])
    names = [column[0] for column in cursor.description]
    return sorted(names), rows_of(names, cursor.fetchall())


def spark_rows(spark: SparkSession, key: str, sf_dir: str):
    df = QUERIES[key](spark, sf_dir)
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(spark, db, key: str, sf_dir: str) -> str | None:
    """None when both sides agree, else a short account of how they differ."""
    names, ours = spark_rows(spark, key, sf_dir)
    if key not in ORACLE:
        return None
    expected_names, theirs = oracle_rows(db, key)
    if names != expected_names:
        return f"columns {names} / {expected_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a}\n   / {b}"
    return None


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    spark, db, failures = session(), connect(sf_dir), 0
    for key in arguments[1:] or QUERIES:
        started = time.time()
        try:
            found = difference(spark, db, key, sf_dir)
        except Exception:
            found = traceback.format_exc()[-1500:]
        failures += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {key} {time.time() - started:.2f}s"
              + (f"\n   {found}" if found else ""), flush=True)
    print(f"{failures} failures, {len(QUERIES)} queries, {len(ORACLE)} oracles")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
