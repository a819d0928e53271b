"""Per-series work over time: differences, running totals and end-to-end deltas.

Windows here never hold a whole series. A series is cut into chunks, each chunk is summarised
by partial aggregation, and what a chunk needs from its predecessors is added to it as one
extra row. One window task therefore sees one chunk, however long a hot series grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clamp_zero, finite_or_null
from .latest import arrival_order

DAY_US = 86_400_000_000
# Rows one window task may see of a series.
CHUNK_ROWS = 1_000_000
MEASURED = "measured"


def chunk_of(order: str, width: int) -> Column:
    return F.call_function("div", F.col(order) - F.pmod(F.col(order), F.lit(width)), F.lit(width).cast("bigint"))


def chunk_width(points: DataFrame, keys: Sequence[str], limit: int = CHUNK_ROWS) -> int:
    """Widest chunk, a day at most, that holds no more than ``limit`` rows of any series.

    Counts rows per series and chunk with partial aggregation and narrows the chunk until the
    fullest fits; usually one pass. Only rows of one microsecond cannot be parted.
    """
    width = DAY_US
    while True:
        counts = points.groupBy(*keys, chunk_of("ts_us", width)).agg(F.count(F.lit(1)).alias("c"))
        fullest = counts.agg(F.max("c")).first()[0] or 0
        if fullest <= limit or width == 1:
            return width
        width = max(1, min(width // 2, width * limit // fullest))


def counter_diffs(
    points: DataFrame,
    keys: Sequence[str] = ("series_key",),
    value: str = "value",
    seq: str | None = None,
    chunk_us: int | str | None = MEASURED,
) -> DataFrame:
    """Consecutive difference per series at the later point; a fall counts as 0.

    No row is emitted where either neighbour is missing or not finite. ``points`` needs ``ts_us``
    and, if timestamps repeat within a series, an arrival number ``seq``. Chunks are measured
    unless a width is given; ``chunk_us=None`` uses one window per series, for input already
    bounded by a validated range query.
    """
    if chunk_us == MEASURED:
        chunk_us = chunk_width(points, keys)
    order = ["ts_us", *([seq] if seq else [])]
    if chunk_us is None:
        rows = points.withColumn("_v", finite_or_null(value))
        rows = rows.withColumn("_prev", F.lag("_v").over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        rows = _lagged_in_chunks(points, keys, finite_or_null(value), order, chunk_us, arrival_order("ts_us", seq if seq else F.lit(0)))
    return (
        rows.filter(F.col("_v").isNotNull() & F.col("_prev").isNotNull())
        .withColumn("diff", clamp_zero(F.col("_v") - F.col("_prev")))
        .drop("_v", "_prev")
    )


def _lagged_in_chunks(
    rows: DataFrame, keys: Sequence[str], value: Column, order: Sequence[str], width: int, tail: Column
) -> DataFrame:
    """Adds the value of each row as ``_v`` and of the row before it as ``_prev``.

    Rows are dealt out once, by 128 hashed bits of series and chunk. The window, the last value of
    each chunk and the join that brings it to the first row of the next chunk all use that exchange;
    only the last values, one row per chunk, move again.
    """
    cut = rows.withColumn("_chunk", chunk_of("ts_us", width))
    of = [*keys, "_chunk"]
    marks = {"_g": F.xxhash64(*of), "_h": F.xxhash64(F.lit("second"), *of)}
    dealt = cut.withColumns(marks).repartition("_g", "_h").withColumn("_v", value)
    inside = Window.partitionBy("_g", "_h", *of).orderBy(*order)
    lagged = dealt.withColumn("_prev", F.lag("_v").over(inside)).withColumn("_place", F.row_number().over(inside))
    edges = dealt.groupBy("_g", "_h", *of).agg(F.max_by("_v", tail).alias("_before"))
    following = F.lead("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk"))
    carried = edges.select(*keys, "_before", following.alias("_chunk")).filter(F.col("_chunk").isNotNull())
    carried = carried.select(*[m.alias(k) for k, m in marks.items()], "_before")
    joined = lagged.join(carried, ["_g", "_h"], "left")
    first = F.when(F.col("_place") == 1, F.col("_before")).otherwise(F.col("_prev"))
    return joined.withColumn("_prev", first).drop("_g", "_h", "_chunk", "_place", "_before")


def running_total(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, width: int, out: str = "running"
) -> DataFrame:
    """Inclusive running sum of ``value`` by ``order`` (a BIGINT, unique per key)."""
    cut = rows.withColumn("_chunk", chunk_of(order, width)).withColumn("_own", F.lit(1)).withColumn("_x", F.col(value))
    # One row per chunk: the only window here without a bound on its rows has one per chunk.
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum("_x").alias("_x"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_x", F.sum("_x").over(earlier)).filter(F.col("_x").isNotNull())
    both = cut.unionByName(carried.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_own", order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.sum("_x").over(inside)).filter("_own = 1").drop("_x", "_own", "_chunk")


def first_last_delta(
    points: DataFrame, keys: Sequence[str] = ("series_key",), value: str = "value", seq: str | None = None
) -> DataFrame:
    """Last minus first finite value per series, not below 0; the arrival number ``seq`` settles equal times."""
    v = finite_or_null(value)
    at = F.when(v.isNotNull(), arrival_order("ts_us", seq) if seq else F.col("ts_us"))
    return (
        points.groupBy(*keys)
        .agg(F.min_by(v, at).alias("first_value"), F.max_by(v, at).alias("last_value"))
        .filter(F.col("first_value").isNotNull())
        .withColumn("delta", clamp_zero(F.col("last_value") - F.col("first_value")))
    )
