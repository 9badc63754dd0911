"""Run registered queries next to their SQL: python tests/oracle_check.py [sf] [name part ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from pairlab.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, connection, name: str, folder: str) -> str:
    df = contract.queries()[name](spark, folder)
    columns = df.columns
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoopJoin" in plan or "CartesianProduct" in plan:
        return "FAIL the plan joins every row with every row"
    rows = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(rows)})"
    result = connection.execute(sql)
    other_columns = [d[0] for d in result.description]
    other = result.fetchall()
    if sorted(columns) != sorted(other_columns):
        return f"FAIL columns {sorted(columns)} vs {sorted(other_columns)}"
    if len(rows) != len(other):
        return f"FAIL rows {len(rows)} vs {len(other)}"
    a, b = _sorted(rows, columns), _sorted(other, other_columns)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"FAIL {len(bad)}/{len(a)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    if not rows:
        return "ok but EMPTY"
    return f"ok ({len(rows)})"


def connect(folder: str):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connection


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in contract.queries():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            verdict = compare(spark, connection, name, folder)
        except Exception as e:  # report and go on with the other queries
            verdict = f"FAIL {type(e).__name__}: {str(e)[:600]}"
            if "-v" in wanted:
                traceback.print_exc()
        failed += verdict.startswith("FAIL")
        print(f"{name:34s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
