"""Row-by-row comparison of Spark queries with SQL over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows(columns, records):
    """Sorted rows with columns in name order, so that only content counts."""
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted((tuple(_cell(r[i]) for i in order) for r in records), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both results are equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows(names, cursor.fetchall())
    if sorted(c.lower() for c in names) != sorted(c.lower() for c in spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    actual = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if actual == expected:
        return None
    missing = [r for r in expected if r not in set(actual)][:3]
    extra = [r for r in actual if r not in set(expected)][:3]
    return f"{len(actual)} rows, expected {len(expected)}; missing {missing}; extra {extra}"
