"""Run questions beside their SQL twins: ``python tests/compare_sql.py [folder] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as driver  # noqa: E402
from tapeloom.runtime import session  # noqa: E402


def normal(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "null" if value != value else f"{value:.6f}"
    return "null" if value is None else str(value)


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def table(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, folder: str, name: str) -> str:
    df = driver.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got)})"
    names, rows = sql_rows(folder, sql)
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} against {sorted(names)}"
    mine, theirs = table(df.columns, got), table(names, rows)
    if mine == theirs:
        return f"ok ({len(mine)})"
    only = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
    return f"DIFFERS {len(mine)} against {len(theirs)}: {only}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or driver.queries():
        start = time.time()
        try:
            outcome = compare(spark, folder, name)
        except Exception as problem:  # noqa: BLE001 - report and go on with the next question
            outcome = f"FAILED {type(problem).__name__}: {str(problem)[:600]}"
        print(f"{name}: {outcome} {time.time() - start:.2f}s", flush=True)
