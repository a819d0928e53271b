"""Comparing a Spark result with its DuckDB counterpart, as multisets of normalised rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, Decimal, float)):
        number = float(value)
        return "NaN" if math.isnan(number) else number + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = bag(names, found.fetchall())
    actual = bag(spark_df.columns, spark_df.collect())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if actual == expected:
        return None if expected else "EMPTY"
    extra, missing = actual - expected, expected - actual
    return f"{sum(actual.values())} rows vs {sum(expected.values())}; extra {list(extra)[:2]} missing {list(missing)[:2]}"
