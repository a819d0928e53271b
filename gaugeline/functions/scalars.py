"""Scalar column functions."""

from __future__ import annotations

import datetime as dt
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..session import require_utc

# Seconds per step unit.
STEP_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
# Seconds per time-bucket part.
PART_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}

_STEP = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)([smhdw]?)$"
_INF = float("inf")


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def moment(when: dt.datetime | int, kind: str = "timestamp_ntz") -> Column:
    """A UTC timestamp literal of the given column type, from a naive datetime or epoch microseconds."""
    if isinstance(when, int):
        when = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=when)
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz").cast(kind)


def epoch_micros(when: dt.datetime) -> int:
    """Epoch microseconds of a naive UTC datetime, exactly."""
    return (when - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of either timestamp type."""
    require_utc()
    return F.unix_micros(_col(ts).cast("timestamp"))


def bucket_us(part: str, ts: str | Column = "ts") -> Column:
    """Start of the minute, hour or day a timestamp lies in, as epoch microseconds."""
    width = F.lit(PART_SECONDS[part] * 1_000_000).cast("bigint")
    us = micros(ts)
    return us - F.pmod(us, width)


def epoch_ms(us: str | Column) -> Column:
    """Whole milliseconds, rounded down."""
    return F.call_function("div", _col(us) - F.pmod(_col(us), F.lit(1000)), F.lit(1000))


def finite_or_null(value: str | Column) -> Column:
    v = _col(value)
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(_INF)), v)


def clamp_zero(value: Column) -> Column:
    """max(0, x); a null stays null instead of becoming 0."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def round2(value: str | Column) -> Column:
    return F.round(_col(value), 2)


def step_seconds(text: str | Column) -> Column:
    """``90``, ``30s``, ``1.5m``, ``2h``, ``1d`` or ``1w`` as seconds; null when invalid or below 1 s."""
    t = F.trim(_col(text))
    number = F.regexp_extract(t, _STEP, 1).try_cast("double")
    units = F.create_map(*[F.lit(x) for pair in (("", 1), *STEP_UNITS.items()) for x in pair])
    seconds = number * F.element_at(units, F.regexp_extract(t, _STEP, 2))
    return F.when((seconds >= 1) & (seconds < F.lit(_INF)), seconds)


def step_value(step: float | int | str) -> float:
    """The same rule for one argument; raises on a bad step."""
    found = re.match(_STEP, str(step).strip())
    seconds = float(found.group(1)) * STEP_UNITS.get(found.group(2), 1) if found else math.nan
    if not math.isfinite(seconds) or seconds < 1:
        raise ValueError(f"step must be a duration of at least 1s, got {step!r}")
    return seconds


@F.pandas_udf(T.StringType())
def _shortest(values: pd.Series) -> pd.Series:
    text = [None if pd.isna(v) else np.format_float_positional(v, unique=True, trim="-") for v in values]
    return pd.Series(text, dtype=object)


def _parts(text: Column) -> tuple[Column, Column, Column]:
    """Digits before and after the point of the JVM's text for a number, and its power of ten."""
    fraction = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)", 1), r"0+$", "")
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E[+]?(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.regexp_extract(text, r"^-?([0-9]+)", 1), fraction, power


def plain_digits(text: Column) -> Column:
    """The JVM's text for a finite number without power of ten and without a bare fraction of zeros."""
    whole, fraction, power = _parts(text)
    digits = F.concat(whole, fraction)
    point = F.length(whole) + power
    size = F.length(digits)
    spread = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), spread)


def prom_float(value: str | Column) -> Column:
    """Shortest plain decimal; ``NaN``, ``+Inf`` and ``-Inf`` for the special values.

    Stays in the JVM where its text has at most 15 digits: no two such decimals are one double, so
    that text is the shortest. Only longer ones reach the Python worker.
    """
    v = _col(value)
    special = (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(v), "NaN")
        .when(v == F.lit(_INF), "+Inf")
        .when(v == F.lit(-_INF), "-Inf")
        .when(v.cast("string") == "-0.0", "-0")
    )
    whole = (F.abs(v) <= 9007199254740992) & (v == F.floor(v))
    text = v.cast("string")
    before, after, _ = _parts(text)
    short = (F.length(before) + F.length(after) <= 15) & (F.abs(v) > 1e-300)
    rest = ~F.isnan(v) & (F.abs(v) < F.lit(_INF)) & ~whole & ~short
    return (
        special.when(whole, F.when(whole, v).cast("bigint").cast("string"))
        .when(short, plain_digits(text)).otherwise(_shortest(F.when(rest, v)))
    )


def is_plain_number(text: Column) -> Column:
    """Whether a number is already in its shortest plain spelling (at most 15 digits), or ``+Inf``."""
    return text.rlike(r"^(?:-?(?:0|[1-9][0-9]{0,7})(?:\.[0-9]{0,6}[1-9])?|\+Inf)$")


def float_text(text: Column) -> Column:
    """Normalise the spelling of a label that holds a number: ``5.0`` to ``5``, ``1e3`` to ``1000``.

    Text without a number is left as it is. Stays in the JVM, because it runs during ingest.
    """
    number = text.try_cast("double")
    exact = text.try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    digits = F.length(F.regexp_replace(F.regexp_replace(text, r"[eE].*$", ""), r"[^0-9]", ""))
    return (
        F.when(text.rlike(r"^(?:0|[1-9][0-9]{0,7})\.[0-9]{1,7}$"), F.regexp_replace(text, r"\.?0+$", ""))
        .when(number.isNull(), text)
        .when(F.isnan(number), "NaN")
        .when(number == F.lit(_INF), "+Inf")
        .when(number == F.lit(-_INF), "-Inf")
        .when((digits <= 15) & exact.isNotNull() & (exact.cast("double") == number), plain)
        .when((digits <= 15) & text.rlike(r"^-?[1-9][0-9]*(\.[0-9]+)?[eE][+-]?[0-9]{1,3}$"), plain_digits(F.upper(text)))
        .otherwise(plain_digits(number.cast("string")))
    )
