"""Latest value per group, with ties on the timestamp settled by arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import canonical, labels_json

# Above twice the BIGINT range, so that the timestamp always decides before the arrival number.
_SPAN = 20_000_000_000_000_000_000


def arrival_order(ts_us: str | Column = "ts_us", seq: str | Column = "seq") -> Column:
    """One number that sorts by (timestamp, arrival); a row without arrival number counts as the first of its time.

    A decimal instead of a struct keeps max_by inside hash aggregation: Spark can update a
    fixed-width buffer in place, while a struct buffer makes it sort every input row first.
    """
    ts, arrival = (F.col(c) if isinstance(c, str) else c for c in (ts_us, seq))
    earliest_of_all = F.lit(-(2**63))
    wide = ts.cast("decimal(19,0)") * F.lit(str(_SPAN)).cast("decimal(20,0)") + F.coalesce(arrival, earliest_of_all).cast("decimal(19,0)")
    return wide.cast("decimal(38,0)")


def latest(value: str | Column, order: Column, skip_null: bool = False) -> Column:
    """Value at the greatest order; ``skip_null`` passes over rows without a value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(v.isNotNull(), order) if skip_null else order)


def earliest(value: str | Column, order: Column) -> Column:
    return F.min_by(value, order)


def latest_by_labels(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest ``value`` and its ``ts_us`` per keys and canonical ``labels``.

    Rows need ``labels, ts_us, seq, value``. Text that ingest did not write (no ``series_key``
    column) may spell the same labels in several ways. It is first grouped as it stands, and only
    the few rows left are brought into canonical form and grouped again: putting every sample's
    JSON in order would cost far more than the second, small shuffle.
    """
    is_map = dict(rows.dtypes)["labels"].startswith("map")
    text = F.coalesce(labels_json(F.col("labels")), F.lit("{}")) if is_map else F.col("labels")

    def newest(of: DataFrame) -> DataFrame:
        return of.groupBy(*keys, "labels").agg(
            F.max_by("value", "_order").alias("value"), F.max("ts_us").alias("ts_us"), F.max("_order").alias("_order")
        )

    first = newest(rows.select(*keys, text.alias("labels"), "ts_us", "value", arrival_order().alias("_order")))
    if is_map or "series_key" in rows.columns:
        return first.drop("_order")
    return newest(first.withColumn("labels", canonical())).drop("_order")
