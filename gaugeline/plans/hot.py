"""Reports over the recent window, from bucketed cumulative counters."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P
from ..functions.labels import label, or_unknown
from ..functions.scalars import epoch_micros, finite_or_null
from ..operators import ring
from ..operators.rangequery import RangeQuery, TooManyPoints, latest_per_bucket, query_range, within
from ..operators.series import counter_diffs, first_last_delta
from ..session import checkpointed
from .cold import REQUESTS, UNIQUES, VISITORS, summary, top_errors

# Metric names and plan constants.
DURATION_SUM = "http_request_duration_ms_sum"
DURATION_COUNT = "http_request_duration_ms_count"
CADENCE_SECONDS = 15
TARGET_BUCKETS = 240
WINDOW_SECONDS = {"1h": 3600, "24h": 86_400}
WIDEST_SECONDS = 7 * 86_400


@dataclass(frozen=True)
class Plan:
    """Window and step of one refresh."""

    start_us: int
    end_us: int
    step: int
    covered_us: int


def window_seconds(range_key: str) -> int:
    return WINDOW_SECONDS.get(range_key, WIDEST_SECONDS)


def plan_from_span(oldest_us: int | None, newest_us: int | None, range_key: str, as_of_us: int) -> Plan:
    """Fit window and step to the covered span, so that counters are seen in several buckets."""
    low = as_of_us - window_seconds(range_key) * 1_000_000
    start = low if oldest_us is None else max(low, oldest_us)
    end = as_of_us if newest_us is None else newest_us
    covered = max(0, end - start)
    step = max(CADENCE_SECONDS, math.ceil(covered / (TARGET_BUCKETS * 1_000_000)))
    return Plan(start, end, step, covered)


def plan_window(samples: DataFrame, range_key: str, as_of: dt.datetime, whole_seconds: bool = False) -> Plan:
    """Plan for what ``samples`` covers.

    ``whole_seconds`` floors both ends of the span, which leaves out a newest scrape that is
    not on a whole second; by default the span is exact.
    """
    span = ring.buffer_span(samples).first()
    ends = [span["oldest_us"], span["newest_us"]]
    if whole_seconds:
        ends = [None if e is None else e - e % 1_000_000 for e in ends]
    return plan_from_span(*ends, range_key, epoch_micros(as_of))


def plan_table(samples: DataFrame, range_key: str, as_of: dt.datetime) -> DataFrame:
    """The same plan as a one-row table."""
    low, now = epoch_micros(as_of) - window_seconds(range_key) * 1_000_000, epoch_micros(as_of)
    ends = ring.buffer_span(samples).select(
        F.greatest(F.lit(low), F.col("oldest_us")).alias("start_us"),
        F.coalesce(F.col("newest_us"), F.lit(now)).alias("end_us"),
    )
    covered = F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))
    step = F.greatest(F.lit(CADENCE_SECONDS).cast("bigint"), F.ceil(covered / F.lit(TARGET_BUCKETS * 1_000_000)))
    return ends.select("start_us", "end_us", step.alias("step"), covered.alias("covered_us"))


def _series_label(key: str) -> Column:
    return label(key, F.col("labels"))


def throughput(points: DataFrame, names: tuple[str, str, str] = (REQUESTS, DURATION_SUM, DURATION_COUNT)) -> DataFrame:
    """Sum of counter differences per winning time; mean latency from the sum and count companions.

    ``points`` come from a validated range query, so a series has at most one point per second of
    seven days, and its differences can be taken in one window.
    """
    diffs = counter_diffs(points.filter(P.named_any(names)), chunk_us=None)
    return merge_companions(diffs, names)


def merge_companions(diffs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Align the three difference streams on time without a join."""
    total, of_sum, of_count = (F.sum(F.when(P.named(n), F.col("diff"))) for n in names)
    rows = diffs.groupBy("ts_us").agg(
        F.coalesce(total, F.lit(0.0)).alias("reqs"),
        F.coalesce(of_sum, F.lit(0.0)).alias("_sum"),
        F.coalesce(of_count, F.lit(0.0)).alias("_count"),
    )
    return rows.select(
        F.col("ts_us").alias("bucket_us"),
        "reqs",
        F.when(F.col("_count") > 0, F.col("_sum") / F.nullif("_count", F.lit(0.0))).alias("avg_ms"),
        F.lit(None).cast("double").alias("p99_ms"),
    ).orderBy("bucket_us")


def error_counts(points: DataFrame) -> DataFrame:
    """Last minus first per series, added up by path; all paths with errors."""
    deltas = first_last_delta(points.filter(P.named(REQUESTS)), ["name", "labels"])
    status = F.coalesce(_series_label("status"), F.lit(""))
    rows = deltas.select(or_unknown(_series_label("path")).alias("path"), status.alias("status"), "delta")
    c4, c5 = (F.sum(F.when(P.status_class(F.col("status"), d), F.col("delta")).otherwise(0.0)) for d in "45")
    by_path = rows.groupBy("path").agg(c4.alias("c4xx"), c5.alias("c5xx"), F.sum("delta").alias("total"))
    return by_path.filter(F.col("c4xx") + F.col("c5xx") > 0)


def error_distribution(points: DataFrame) -> DataFrame:
    """The paths with the most errors."""
    return top_errors(error_counts(points))


def visitors(points: DataFrame) -> DataFrame:
    """Visitors and uniques side by side per second, target and region.

    The row keeps the time of the first visitors point of its second, or of the first uniques
    point if there is none. Several points of one cell: the greatest (time, series) wins.
    """
    second = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(1_000_000))
    rows = points.filter(P.named_any([VISITORS, UNIQUES])).select(
        second.alias("_second"),
        or_unknown(_series_label("scrape_target")).alias("target"),
        or_unknown(_series_label("region")).alias("region"),
        "name", "ts_us", "series_key", finite_or_null("value").alias("value"),
    ).filter(F.col("value").isNotNull())
    order = F.struct("ts_us", "series_key")
    cell = rows.groupBy("_second", "target", "region").agg(
        F.coalesce(F.min(F.when(P.named(VISITORS), F.col("ts_us"))), F.min("ts_us")).alias("bucket_us"),
        F.max_by("value", F.when(P.named(VISITORS), order)).alias("visitors"),
        F.max_by("value", F.when(P.named(UNIQUES), order)).alias("uniques"),
    )
    return cell.select("bucket_us", "target", "region", "visitors", "uniques").orderBy("bucket_us", "target", "region")


def custom(points: DataFrame) -> DataFrame:
    """Mean over the series that have a finite value at a time."""
    v = finite_or_null("value")
    return (
        points.withColumn("_v", v).filter(F.col("_v").isNotNull())
        .groupBy(F.col("ts_us").alias("bucket_us"))
        .agg(F.avg("_v").alias("v"), F.count(F.lit(1)).alias("n"))
        .orderBy("bucket_us")
    )


def run_custom(
    samples: DataFrame, metric: str, range_key: str, as_of: dt.datetime, matchers: Mapping[str, str] | None = None
) -> DataFrame:
    plan = plan_window(samples, range_key, as_of)
    query = RangeQuery(metric, plan.start_us, min(plan.end_us, epoch_micros(as_of)), plan.step * 1_000_000, matchers or {})
    return custom(query_range(samples, query))


def dashboard_points(samples: DataFrame, plan: Plan, target: str | None = "", max_points: int | None = None) -> DataFrame:
    """Bucketed points of the five report metrics from one scan.

    Nothing is left out and no step is changed because of the size of the answer. Where the caller
    gives a cap, a metric beyond it raises, whichever it is; widening is a matter of
    :func:`query_range_adaptive`.
    """
    names = [REQUESTS, DURATION_SUM, DURATION_COUNT, VISITORS, UNIQUES]
    scoped = within(samples.filter(P.named_any(names)), plan.start_us, plan.end_us)
    scoped = scoped.filter(P.of_target(scoped, target))
    held = checkpointed(latest_per_bucket(scoped, plan.start_us, plan.step * 1_000_000))
    if max_points is not None:
        over = held.groupBy("name").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > max_points).agg(F.max("c")).first()[0]
        if over:
            raise TooManyPoints(over, max_points)
    return held


def dashboard(
    samples: DataFrame, range_key: str, as_of: dt.datetime, target: str | None = "", max_points: int | None = None
) -> dict[str, DataFrame]:
    """All reports of one refresh over a single scan of the window."""
    plan = plan_window(samples, range_key, as_of)
    points = dashboard_points(samples, plan, target, max_points)
    rows, errors = checkpointed(throughput(points)), checkpointed(error_counts(points))
    return {
        "throughput": rows,
        "errors": top_errors(errors),
        "names": ring.metric_names(samples),
        "visitors": visitors(points),
        "summary": summary(rows, errors, plan.step),
    }

