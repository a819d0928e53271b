"""Range queries: the latest sample per series and step bucket."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P
from ..functions.labels import canonical, labels_json
from ..functions.scalars import epoch_micros, micros, step_value
from .latest import latest_by_labels

# Query limits.
MAX_POINTS = 10_000
MAX_RANGE_SECONDS = 7 * 24 * 3600
RETRIES = 2
# Fixed value: how much wider than needed a widened step is made.
MARGIN = 1.05


@dataclass(frozen=True)
class RangeQuery:
    """A validated query; build it with :func:`range_args`."""

    name: str
    start_us: int
    end_us: int
    step_us: int
    matchers: Mapping[str, str] = field(default_factory=dict)


class TooManyPoints(ValueError):
    def __init__(self, points: int, limit: int):
        super().__init__(f"the answer has {points} points, {limit} are allowed; take a wider step")
        self.points = points


def _seconds(value: float | int | str | dt.datetime, what: str) -> float:
    if isinstance(value, dt.datetime):
        return epoch_micros(value) / 1e6
    try:
        seconds = float(value)
    except (TypeError, ValueError):
        seconds = math.nan
    if not math.isfinite(seconds) or seconds < 0:
        raise ValueError(f"invalid {what} {value!r}: expected unix seconds")
    return seconds


def range_args(
    name: str,
    start: float | str | dt.datetime,
    end: float | str | dt.datetime,
    step: float | str,
    as_of: float | dt.datetime,
    matchers: Mapping[str, str] | None = None,
) -> RangeQuery:
    """Check the arguments of a range query; ``end`` is held back to ``as_of``. Bad input raises."""
    if not name or not name.strip():
        raise ValueError("a range query needs a metric name")
    begin, finish = _seconds(start, "start"), _seconds(end, "end")
    width = step_value(step)
    finish = min(finish, _seconds(as_of, "as_of"))
    if finish <= begin:
        raise ValueError("the range is empty: it ends no later than it starts")
    if finish - begin > MAX_RANGE_SECONDS:
        raise ValueError(f"the range is longer than {MAX_RANGE_SECONDS // 86400} days")
    return RangeQuery(name.strip(), int(begin * 1e6), int(finish * 1e6), int(width * 1e6), dict(matchers or {}))


def step_bucket(us: Column, start_us: int, step_us: int | Column) -> Column:
    """Index of the step a moment falls into; steps are counted from the start of the query."""
    width = step_us if isinstance(step_us, Column) else F.lit(step_us)
    return F.call_function("div", us - F.lit(start_us).cast("bigint"), width.cast("bigint"))


def within(samples: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Samples of a closed time range; the bounds reach the scan."""
    first, last = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=u) for u in (start_us, end_us))
    return samples.filter(P.between_closed(samples, first, last))


def latest_per_bucket(samples: DataFrame, start_us: int, step_us: int | Column) -> DataFrame:
    """One row per series and step, stamped with the winning sample's own time.

    A single shuffle on (series, bucket) after partial aggregation: a hot series sends one row
    per bucket and task, not its samples.
    """
    timed = samples.withColumn("ts_us", micros("ts"))
    bucketed = timed.withColumn("bucket", step_bucket(F.col("ts_us"), start_us, step_us))
    newest = latest_by_labels(bucketed, ["name", "bucket"])
    return newest.select(F.concat("name", "labels").alias("series_key"), "name", "labels", "bucket", "ts_us", "value")


def _hits(samples: DataFrame, query: RangeQuery) -> DataFrame:
    hits = within(samples.filter(P.named(query.name)), query.start_us, query.end_us)
    return hits.filter(P.matches(hits, query.matchers))


def _times(hits: DataFrame) -> DataFrame:
    """The different times of each series: all that the size of an answer depends on, whatever its step."""
    is_map = dict(hits.dtypes)["labels"].startswith("map")
    text = F.coalesce(labels_json(F.col("labels")), F.lit("{}")) if is_map else F.col("labels")
    times = hits.select(text.alias("labels"), micros("ts").alias("ts_us")).distinct()
    return times if is_map or "series_key" in hits.columns else times.withColumn("labels", canonical())


def count_points(times: DataFrame, start_us: int, step_us: int) -> int:
    """Points of an answer: series and steps that have a sample."""
    return times.select("labels", step_bucket(F.col("ts_us"), start_us, step_us)).distinct().count()


def query_range(samples: DataFrame, query: RangeQuery, max_points: int | None = None) -> DataFrame:
    """Run a range query; a metric without samples gives an empty result.

    With ``max_points`` the points are counted first, and too large an answer raises :class:`TooManyPoints` instead of being
    cut. Nothing is written.
    """
    hits = _hits(samples, query)
    if max_points is not None:
        count = count_points(_times(hits), query.start_us, query.step_us)
        if count > max_points:
            raise TooManyPoints(count, max_points)
    return latest_per_bucket(hits, query.start_us, query.step_us)


def widened(step: float, points: int, limit: int = MAX_POINTS) -> int:
    return max(math.floor(step) + 1, math.ceil(step * points * MARGIN / limit))


def query_range_adaptive(
    samples: DataFrame, query: RangeQuery, max_points: int = MAX_POINTS, retries: int = RETRIES
) -> tuple[DataFrame, RangeQuery]:
    """Widen the step while the answer is too large; returns the answer and the query that gave it.

    The samples are read once to choose the step: the times of the series are kept meanwhile, and every step is counted on
    them. The answer is then computed for that step alone.
    """
    times = _times(_hits(samples, query)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for attempt in range(retries + 1):
            points = count_points(times, query.start_us, query.step_us)
            if points <= max_points:
                return query_range(samples, query), query
            if attempt == retries:
                raise TooManyPoints(points, max_points)
            query = replace(query, step_us=widened(query.step_us / 1e6, points, max_points) * 1_000_000)
    finally:
        times.unpersist()
    raise AssertionError("unreachable")


def coverage_warning(samples: DataFrame, start_us: int) -> DataFrame:
    """Whether the query starts before the first sample that arrived, of whichever metric."""
    oldest = F.min_by(micros("ts"), "seq")
    return samples.agg(F.coalesce(oldest > F.lit(start_us), F.lit(False)).alias("clamped"))

