"""Chart-ready shapes: long rows of (series, milliseconds, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import epoch_ms, round2


def _long(report: DataFrame, ids: list, values: dict[str, str]) -> DataFrame:
    """Unpivot the value columns under their series names and drop the gaps."""
    pieces = report.select(*ids, *[F.col(c).cast("double").alias(name) for c, name in values.items()])
    keys = [c for c in pieces.columns if c not in values.values()]
    return pieces.unpivot(keys, list(values.values()), "series", "value").filter(F.col("value").isNotNull())


def latency_series(throughput: DataFrame) -> DataFrame:
    rows = throughput.select("bucket_us", round2("avg_ms").alias("avg_ms"), round2("p99_ms").alias("p99_ms"))
    return _long(rows, [epoch_ms("bucket_us").alias("ms")], {"avg_ms": "avg", "p99_ms": "p99"})


def visitor_series(visitors: DataFrame) -> DataFrame:
    group = F.concat("target", F.lit(" / "), "region").alias("grp")
    long = _long(visitors, [epoch_ms("bucket_us").alias("ms"), group], {"uniques": "uniques", "visitors": "total"})
    return long.select(F.concat("grp", F.lit(" "), "series").alias("series"), "ms", "value")


def throughput_series(throughput: DataFrame) -> DataFrame:
    return throughput.select(epoch_ms("bucket_us").alias("ms"), F.col("reqs").cast("double").alias("value"))


def custom_series(custom: DataFrame) -> DataFrame:
    return custom.select(epoch_ms("bucket_us").alias("ms"), F.col("v").cast("double").alias("value"))


def error_bars(errors: DataFrame) -> DataFrame:
    return _long(errors, ["path"], {"c4xx": "4xx", "c5xx": "5xx"})
