"""Dense time grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import small_side


def bucket_spine(rows: DataFrame, members: DataFrame, ts: str = "ts", width: str = "1 HOUR") -> DataFrame:
    """Every bucket between the first and last ``ts`` for every distinct member row.

    Members carry the bounds along and grow their own buckets, so the grid is built by a narrow
    explode per member and not by a join.
    """
    step = F.expr(f"INTERVAL {width}")
    part = width.split()[-1].lower()
    low = rows.agg(F.date_trunc(part, F.min(ts))).scalar()
    high = rows.agg(F.date_trunc(part, F.max(ts))).scalar()
    return members.distinct().select("*", F.explode(F.sequence(low, high, step)).alias("bucket"))


def fill_gaps(spine: DataFrame, report: DataFrame, keys: list[str]) -> DataFrame:
    """Lay a report onto a grid; cells without data hold nulls."""
    return spine.join(small_side(report), keys, "left")


def lateral_expand(rows: DataFrame, n: Column, out: str = "i") -> DataFrame:
    """One row per integer from 1 to ``n`` of each row; none where ``n`` is below 1."""
    return rows.select("*", F.explode(F.when(n >= 1, F.sequence(F.lit(1).cast("bigint"), n))).alias(out))
