"""Compare queries with their SQL in DuckDB: python tests/check_queries.py [sf] [names...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def local_session():
    from panelloom.session import get_session

    spark = get_session(
        "checks",
        "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}".replace("-0.000000", "0.000000")
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def compare(spark, con, name, folder):
    from __spark_entry__ import oracle_sql, queries

    start = time.time()
    frame = queries()[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    seconds = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return len(rows), seconds, "no oracle" if rows else "EMPTY"
    result = con.execute(sql)
    expected = normal([d[0] for d in result.description], result.fetchall())
    actual = normal(frame.columns, rows)
    if actual[0] != expected[0]:
        return len(rows), seconds, f"COLUMNS {actual[0]} != {expected[0]}"
    if len(actual[1]) != len(expected[1]):
        return len(rows), seconds, f"ROWS {len(actual[1])} != {len(expected[1])}"
    wrong = [(a, e) for a, e in zip(actual[1], expected[1]) if a != e]
    return len(rows), seconds, f"VALUES {len(wrong)} e.g. {wrong[0]}" if wrong else "ok"


if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    path = f"/root/testdata/sf{scale}"
    from __spark_entry__ import queries

    session, duck = local_session(), connect(path)
    from __spark_entry__ import oracle_sql

    wanted = sys.argv[2:] or list(queries())
    if wanted == ["sql"]:
        wanted = list(oracle_sql())
    for query_name in wanted:
        try:
            n, spent, verdict = compare(session, duck, query_name, path)
        except Exception as error:  # noqa: BLE001
            n, spent, verdict = -1, 0.0, f"ERROR {str(error)[:600]}"
        print(f"{query_name:32s} {n:7d} {spent:7.2f}s {verdict}", flush=True)
