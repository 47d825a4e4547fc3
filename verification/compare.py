"""Run registered queries next to their SQL and compare every value.

    python -m verification.compare [folder] [query ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from shoplytic import session
from verification.oracles import oracle_sql
from verification.queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: int = 8) -> SparkSession:
    return (
        session.builder("shoplytic-check")
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_value(row[i]) for i in order) for row in rows),
        key=lambda row: [(v is None, str(v)) for v in row],
    )


def differences(spark: SparkSession, connection, folder: str, name: str) -> list[str]:
    """What differs between the query and its SQL; empty when they agree exactly."""
    frame = all_queries()[name](spark, folder)
    result = connection.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = _sorted_rows(columns, result.fetchall())
    actual = _sorted_rows(frame.columns, frame.collect())
    if sorted(columns) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(columns)}"]
    if len(actual) != len(expected):
        return [f"rows {len(actual)} != {len(expected)}"]
    found = []
    for row, other in zip(actual, expected, strict=True):
        if row != other or [type(v) for v in row] != [type(v) for v in other]:
            found.append(f"{row} != {other}")
    return found


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(all_queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(folder)
    bad = 0
    for name in names:
        begin = time.time()
        if name in oracle_sql():
            found = differences(spark, connection, folder, name)
            outcome = "ok" if not found else f"{len(found)} DIFFER, as {found[0]}"
            bad += bool(found)
        else:
            outcome = f"{len(all_queries()[name](spark, folder).collect())} rows, no SQL"
        print(f"{name:32s} {time.time() - begin:6.2f}s  {outcome[:700]}", flush=True)
    print(f"{bad} of {len(names)} differ")


if __name__ == "__main__":
    main()
