"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, float)):
        return None if isinstance(value, float) and math.isnan(value) else float(value) + 0.0
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs, empty when column names, row counts and values agree."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = _rows(columns, result.fetchall())
    actual = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = []
    if sorted(columns) != sorted(spark_df.columns):
        found.append(f"columns {sorted(columns)} != {sorted(spark_df.columns)}")
    if sum(expected.values()) != sum(actual.values()):
        found.append(f"rows: sql {sum(expected.values())}, spark {sum(actual.values())}")
    if expected != actual:
        found.append(f"only in sql: {list((expected - actual).items())[:3]}")
        found.append(f"only in spark: {list((actual - expected).items())[:3]}")
    return found
