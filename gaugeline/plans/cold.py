"""Reports over history (the five-column metrics table).

``reqs`` here is the number of request rows. The recent-window reports in :mod:`.hot` add up
counter differences instead, so the two differ on cumulative data by design.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P
from ..functions.labels import UNKNOWN, label_of, or_unknown
from ..functions.scalars import bucket_us, micros
from ..operators.latest import arrival_order, latest
from ..operators.quantiles import exact_quantiles
from ..session import checkpointed

# Metric names the reports read.
REQUESTS = "http_requests_total"
DURATION = "http_request_duration_ms"
VISITORS = "visitors_total"
UNIQUES = "unique_visitors_estimate"
# Report sizes.
TOP_PATHS = 20
NAME_LIMIT = 200


def _scope(metrics: DataFrame, range_key: str, target: str | None, as_of: dt.datetime) -> DataFrame:
    return metrics.filter(P.in_range(metrics, range_key, as_of) & P.of_target(metrics, target))


def throughput_latency(
    metrics: DataFrame, range_key: str, as_of: dt.datetime, target: str | None = "", approx: bool = False
) -> DataFrame:
    """Request rows, mean and 99th percentile of duration per bucket.

    Buckets come from rows of any metric. ``approx=True`` swaps the exact quantile for a sketch
    and gives different numbers.
    """
    duration = F.when(P.named(DURATION), F.col("value"))
    rows = _scope(metrics, range_key, target, as_of).select(
        bucket_us(P.range_bucket(range_key)).alias("bucket_us"), "name", duration.alias("duration")
    )
    reqs = F.count_if(P.named(REQUESTS))
    if approx:
        sketch = F.percentile_approx("duration", 0.99).alias("p99_ms")
        return rows.groupBy("bucket_us").agg(reqs.alias("reqs"), F.avg("duration").alias("avg_ms"), sketch).orderBy("bucket_us")
    # Counts and sums ride in the counting pass of the quantiles: two scans in all.
    riding = {"reqs": reqs, "_sum": F.sum("duration"), "_n": F.count("duration")}
    out = exact_quantiles(rows, ["bucket_us"], "duration", {"p99_ms": 0.99}, riding=riding)
    mean = F.col("_sum") / F.nullif("_n", F.lit(0).cast("bigint"))
    return out.select("bucket_us", "reqs", mean.alias("avg_ms"), "p99_ms").orderBy("bucket_us")


def error_counts(
    metrics: DataFrame, range_key: str, as_of: dt.datetime, target: str | None = "", errors_only: bool = True
) -> DataFrame:
    """4xx, 5xx and all request rows per path."""
    scoped = _scope(metrics.filter(P.named(REQUESTS)), range_key, target, as_of)
    rows = scoped.select(or_unknown(label_of(scoped, "path")).alias("path"), label_of(scoped, "status").alias("status"))
    counts = rows.groupBy("path").agg(
        F.count_if(P.status_class(F.col("status"), "4")).alias("c4xx"),
        F.count_if(P.status_class(F.col("status"), "5")).alias("c5xx"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.filter(F.col("c4xx") + F.col("c5xx") > 0) if errors_only else counts


def top_errors(errors: DataFrame, n: int = TOP_PATHS) -> DataFrame:
    """Paths with the most errors; the path settles ties."""
    return errors.orderBy(F.desc(F.col("c4xx") + F.col("c5xx")), "path").limit(n)


def error_distribution(
    metrics: DataFrame, range_key: str, as_of: dt.datetime, target: str | None = ""
) -> DataFrame:
    return top_errors(error_counts(metrics, range_key, as_of, target))


def metric_names(metrics: DataFrame, limit: int = NAME_LIMIT) -> DataFrame:
    return metrics.select("name").distinct().orderBy("name").limit(limit)


def targets(metrics: DataFrame) -> DataFrame:
    rows = metrics.filter(P.named(REQUESTS))
    return rows.select(or_unknown(label_of(rows, "scrape_target")).alias("target")).distinct().orderBy("target")


def visitors_by_region(
    metrics: DataFrame, range_key: str, as_of: dt.datetime, target: str | None = ""
) -> DataFrame:
    """Latest visitors and uniques per bucket, target and region; estimates are never added up.

    A row without a value does not hide an older one. ``seq`` settles equal times if the table has it.
    """
    rows = _scope(metrics.filter(P.named_any([VISITORS, UNIQUES])), range_key, target, as_of)
    order = arrival_order(micros("ts"), F.col("seq") if "seq" in rows.columns else F.lit(0))
    keyed = rows.select(
        bucket_us(P.range_bucket(range_key)).alias("bucket_us"),
        or_unknown(label_of(rows, "scrape_target")).alias("target"),
        or_unknown(label_of(rows, "region")).alias("region"),
        order.alias("_order"),
        F.when(P.named(VISITORS), F.col("value")).alias("_visitors"),
        F.when(P.named(UNIQUES), F.col("value")).alias("_uniques"),
    )
    return (
        keyed.groupBy("bucket_us", "target", "region")
        .agg(
            latest("_visitors", F.col("_order"), skip_null=True).alias("visitors"),
            latest("_uniques", F.col("_order"), skip_null=True).alias("uniques"),
        )
        .orderBy("bucket_us", "target", "region")
    )


# How each selectable aggregation combines the values of a bucket; anything else means avg.
_SIMPLE = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
_RANKED = {"p50": 0.5, "p99": 0.99}


def custom_series(
    metrics: DataFrame,
    metric: str,
    range_key: str,
    as_of: dt.datetime,
    agg: str = "avg",
    label_key: str | None = "",
    label_value: str | None = "",
    target: str | None = "",
    approx: bool = False,
) -> DataFrame:
    """One metric, one aggregation, optionally narrowed by a label."""
    rows = _scope(metrics.filter(P.named(metric)), range_key, target, as_of)
    rows = rows.filter(P.has_label(rows, label_key, label_value))
    rows = rows.select(bucket_us(P.range_bucket(range_key)).alias("bucket_us"), "value")
    n = F.count(F.lit(1)).alias("n")
    if agg in _RANKED:
        if approx:
            out = rows.groupBy("bucket_us").agg(F.percentile_approx("value", _RANKED[agg]).alias("v"), n)
        else:
            out = exact_quantiles(rows, ["bucket_us"], "value", {"v": _RANKED[agg]}, riding={"n": F.count(F.lit(1))})
        out = out.select("bucket_us", "v", "n")
    else:
        v = F.count(F.lit(1)) if agg == "count" else _SIMPLE.get(agg, F.avg)("value")
        out = rows.groupBy("bucket_us").agg(v.alias("v"), n)
    return out.orderBy("bucket_us")


def summary(throughput: DataFrame, errors: DataFrame, bucket_seconds: float) -> DataFrame:
    """Totals over a throughput report and the errors of all paths (not the top-limited report)."""
    usable: Column = F.col("avg_ms").isNotNull() & ~F.isnan("avg_ms") & (F.abs("avg_ms") < float("inf"))
    reqs = F.col("reqs").cast("double")
    parts = throughput.select(
        reqs.alias("reqs"),
        F.when(usable, F.col("avg_ms") * reqs).alias("weighted"),
        F.when(usable, reqs).alias("weight"),
        F.lit(0.0).alias("errors"),
    ).unionByName(
        errors.select((F.col("c4xx") + F.col("c5xx")).cast("double").alias("errors")), allowMissingColumns=True
    )
    sums = parts.agg(
        F.coalesce(F.sum("reqs"), F.lit(0.0)).alias("total"),
        F.sum("weighted").alias("weighted"),
        F.sum("weight").alias("weight"),
        F.greatest(F.lit(0.0), F.coalesce(F.max("reqs"), F.lit(0.0))).alias("peak"),
        F.coalesce(F.sum("errors"), F.lit(0.0)).alias("error_count"),
    )
    return sums.select(
        "total",
        F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight")).alias("avg_ms"),
        (F.col("peak") / F.lit(float(bucket_seconds)) if bucket_seconds > 0 else F.col("peak")).alias("peak_per_sec"),
        F.when(F.col("total") > 0, F.col("error_count") / F.nullif("total", F.lit(0.0))).otherwise(0.0).alias("error_rate"),
        "error_count",
    )


def normalise(report: DataFrame) -> DataFrame:
    """Missing counts become 0 and missing names ``(unknown)``; missing measures stay missing."""
    zero = {"reqs", "c4xx", "c5xx", "total", "n"}
    unknown = {"path", "target", "region"}
    return report.select(
        *[
            F.coalesce(c, F.lit(0)).alias(c) if c in zero
            else F.coalesce(c, F.lit(UNKNOWN)).alias(c) if c in unknown
            else F.col(c)
            for c in report.columns
        ]
    )


def dashboard(
    metrics: DataFrame, range_key: str, as_of: dt.datetime, target: str | None = ""
) -> dict[str, DataFrame]:
    """All reports of one refresh. Each scan reads only the metrics and columns of its report.

    The report per bucket and the errors per path are computed once; the summary adds up all paths,
    the listed errors are the top of them. ``names_cut`` says whether more names exist than are listed.
    """
    throughput = normalise(checkpointed(throughput_latency(metrics, range_key, as_of, target)))
    errors = normalise(checkpointed(error_counts(metrics, range_key, as_of, target)))
    names = checkpointed(metric_names(metrics, NAME_LIMIT + 1))
    return {
        "throughput": throughput,
        "errors": top_errors(errors),
        "names": names.orderBy("name").limit(NAME_LIMIT),
        "names_cut": names.agg((F.count(F.lit(1)) > NAME_LIMIT).alias("names_cut")),
        "visitors": normalise(visitors_by_region(metrics, range_key, as_of, target)),
        "summary": summary(throughput, errors, P.range_bucket_seconds(range_key)),
    }
