"""Run named queries and their SQL side by side and compare them row by row."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    return repr(value)


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def oracle_rows(sf_dir: str, sql: str):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def compare(spark: SparkSession, sf_dir: str, name: str) -> tuple[bool, str]:
    frame = entry.queries()[name](spark, sf_dir)
    rows = frame.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(rows)} rows, no SQL"
    names, expected = oracle_rows(sf_dir, sql)
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} against {sorted(names)}"
    ours, theirs = _bag(rows, frame.columns), _bag(expected, names)
    if ours == theirs:
        return len(rows) > 0, f"{len(rows)} rows"
    return False, (
        f"{len(rows)} against {len(expected)} rows\n  only ours: {list((ours - theirs).items())[:3]}"
        f"\n  only theirs: {list((theirs - ours).items())[:3]}"
    )


def session(cpus: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


if __name__ == "__main__":
    scale, wanted = sys.argv[1], sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in wanted or entry.queries():
        start = time.time()
        try:
            ok, note = compare(spark, f"/root/testdata/sf{scale}", name)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note[:1500]}", flush=True)
    print("failed:", failed)
