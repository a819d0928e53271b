"""Row predicates; each is a plain column expression that reaches the Parquet scan where it can."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .labels import label_of
from .scalars import moment

# Look-back of the named ranges; any other key has no lower bound.
RANGE_HOURS = {"1h": 1, "24h": 24}
# Bucket part and width of the named ranges; an unknown key uses the 24h row.
RANGE_BUCKETS = {"1h": ("minute", 60), "24h": ("hour", 3600), "all": ("day", 86400)}


def range_bucket(range_key: str) -> str:
    return RANGE_BUCKETS.get(range_key, RANGE_BUCKETS["24h"])[0]


def range_bucket_seconds(range_key: str) -> int:
    return RANGE_BUCKETS.get(range_key, RANGE_BUCKETS["24h"])[1]


def _day(when: dt.datetime) -> Column:
    return F.lit(when.date().isoformat()).cast("date")


def named(metric: str) -> Column:
    return F.col("name") == F.lit(metric)


def named_any(metrics: Iterable[str]) -> Column:
    return F.col("name").isin(*metrics)


def not_before(df: DataFrame, start: dt.datetime, kind: str) -> Column:
    keep = F.col("ts") >= moment(start, kind)
    return keep & (F.col("dt") >= _day(start)) if "dt" in df.columns else keep


def not_after(df: DataFrame, end: dt.datetime, kind: str) -> Column:
    keep = F.col("ts") <= moment(end, kind)
    return keep & (F.col("dt") <= _day(end)) if "dt" in df.columns else keep


def between_closed(df: DataFrame, start: dt.datetime, end: dt.datetime) -> Column:
    """Both ends inclusive; a ``dt`` partition column is bounded as well, so that files are pruned."""
    kind = dict(df.dtypes)["ts"]
    return not_before(df, start, kind) & not_after(df, end, kind)


def in_range(df: DataFrame, range_key: str, as_of: dt.datetime) -> Column:
    """Lower bound of a named range below ``as_of``; no upper bound."""
    if range_key not in RANGE_HOURS:
        return F.lit(True)
    return not_before(df, as_of - dt.timedelta(hours=RANGE_HOURS[range_key]), dict(df.dtypes)["ts"])


def of_target(df: DataFrame, target: str | None) -> Column:
    """One scrape target; blank and ``all`` keep everything."""
    wanted = str(target or "").strip()
    return F.lit(True) if wanted in ("", "all") else label_of(df, "scrape_target") == F.lit(wanted)


def has_label(df: DataFrame, key: str | None, value: str | None = "") -> Column:
    """Label present and not blank, or equal to a value."""
    key, value = (key or "").strip(), (value or "").strip()
    if not key:
        return F.lit(True)
    found = label_of(df, key)
    return found == F.lit(value) if value else found.isNotNull() & (found != "")


def matches(df: DataFrame, matchers: Mapping[str, str]) -> Column:
    """Every matcher needs its label present and equal; a blank value does not match an absent label."""
    return reduce(
        lambda keep, kv: keep & F.coalesce(label_of(df, kv[0]) == F.lit(kv[1]), F.lit(False)),
        matchers.items(),
        F.lit(True),
    )


def status_class(status: Column, digit: str) -> Column:
    return status.startswith(digit)

