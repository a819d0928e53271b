"""Scalar functions, predicates and argument checks."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeline.functions import labels as L, predicates as P, scalars as S
from gaugeline.operators.rangequery import range_args, widened
from gaugeline.sources.metrics import is_export_name


def column(spark, values, kind, use):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", use(F.col("v")).alias("x")).orderBy("i").collect()]


def test_prom_float_spellings(spark):
    values = [1.0, -0.0, 0.1, 1e21, 1e-7, math.nan, math.inf, -math.inf, None, 123456789.125, 2.0**53, 5e-5]
    assert column(spark, values, "double", S.prom_float) == [
        "1", "-0", "0.1", "1" + "0" * 21, "0.0000001", "NaN", "+Inf", "-Inf", None, "123456789.125", "9007199254740992", "0.00005",
    ]


def test_float_text(spark):
    texts = ["5.0", "5", "0.50", "1e3", "1e-05", "+Inf", "NaN", "abc", "100", "10.0", "0.0", "-0.50", "2.5", "1e22", "2E+23", "1.25e9", "-1.5E-9"]
    assert column(spark, texts, "string", S.float_text) == [
        "5", "5", "0.5", "1000", "0.00001", "+Inf", "NaN", "abc", "100", "10", "0", "-0.5", "2.5", "1" + "0" * 22, "2" + "0" * 23, "1250000000", "-0.0000000015",
    ]


def test_step_spellings(spark):
    texts = ["90", "30s", "1.5m", " 2h ", "1d", "1w", "500ms", "0.5", "x", "", "5 m", "1e2"]
    expected = [90.0, 30.0, 90.0, 7200.0, 86400.0, 604800.0, None, None, None, None, None, 100.0]
    assert column(spark, texts, "string", S.step_seconds) == expected
    for text, want in zip(texts, expected):
        if want is None:
            with pytest.raises(ValueError):
                S.step_value(text)
        else:
            assert S.step_value(text) == want


def test_non_finite_values_become_null(spark):
    assert column(spark, [1.0, math.nan, math.inf, -math.inf, None], "double", S.finite_or_null) == [1.0, None, None, None, None]


def test_clamp_keeps_null(spark):
    assert column(spark, [-1.0, None, 2.0], "double", S.clamp_zero) == [0.0, None, 2.0]


def test_buckets_of_both_timestamp_types(spark):
    when = dt.datetime(2024, 2, 29, 23, 59, 59, 999999)
    row = spark.createDataFrame([(when,)], "ts timestamp_ntz").select(
        S.bucket_us("day").alias("a"), S.bucket_us("minute", F.col("ts").cast("timestamp")).alias("b"), S.epoch_ms(S.micros("ts")).alias("c")
    ).first()
    us = S.epoch_micros(when)
    assert row["a"] == us - us % 86_400_000_000 and row["b"] == us - us % 60_000_000 and row["c"] == us // 1000


def test_timestamps_need_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Jakarta")
    try:
        with pytest.raises(ValueError):
            S.micros("ts")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_labels_with_odd_keys(spark):
    text = """{"g.h":"1","a b":"2","it's":"3","path":""}"""
    df = spark.createDataFrame([(text,)], "labels string")
    row = df.select(L.label("g.h"), L.label("a b"), L.label("it's"), L.or_unknown(L.label("path")), L.or_unknown(L.label("no"))).first()
    assert tuple(row) == ("1", "2", "3", "(unknown)", "(unknown)")


def test_series_key_ignores_label_order(spark):
    df = spark.createDataFrame([("n", '{"b":"2","a":"1"}'), ("n", '{"a":"1","b":"2"}')], "name string, labels string")
    assert df.select(L.series_key(df)).distinct().count() == 1


def metrics(spark):
    rows = [("m", '{"path":"/a","scrape_target":"x"}'), ("m", '{"path":""}'), ("m", "{}")]
    return spark.createDataFrame(rows, "name string, labels string")


def test_a_matcher_needs_its_label_present(spark):
    m = metrics(spark)
    assert m.filter(P.matches(m, {"path": ""})).count() == 1
    assert m.filter(P.matches(m, {"path": "/a", "scrape_target": "x"})).count() == 1
    assert m.filter(P.matches(m, {"nope": ""})).count() == 0
    assert m.filter(P.matches(m, {})).count() == 3


def test_label_present_and_target_filters(spark):
    m = metrics(spark)
    assert m.filter(P.has_label(m, " path ")).count() == 1
    assert m.filter(P.has_label(m, "path", " /a ")).count() == 1
    assert m.filter(P.has_label(m, " ", "x")).count() == 3
    assert [m.filter(P.of_target(m, t)).count() for t in ("", " all ", None, " x ")] == [3, 3, 3, 1]


def test_promoted_columns_are_used(spark):
    m = metrics(spark).withColumn("path", F.lit("/promoted"))
    assert m.filter(P.matches(m, {"path": "/promoted"})).count() == 3


def test_range_keys():
    assert [P.range_bucket(k) for k in ("1h", "24h", "all", "odd")] == ["minute", "hour", "day", "hour"]


def test_export_names(spark):
    names = ["metrics_cold_1.parquet", "metrics_cold_.parquet", "notes.txt", "metrics_cold_1.part", "a/metrics_cold_1.parquet",
             "metrics_cold_../x.parquet", "metrics_cold_\\x.parquet", "", "metrics_cold_..parquet"]
    assert column(spark, names, "string", is_export_name) == [True, True] + [False] * 7


NOW = dt.datetime(2024, 1, 10)


def test_range_arguments_are_clamped_and_checked():
    q = range_args("m", 1704758400.25, "1e12", "1m", NOW)
    assert (q.start_us, q.end_us, q.step_us) == (1704758400250000, S.epoch_micros(NOW), 60_000_000)
    bad = [
        ("", 0, 10, 1), ("m", "x", 10, 1), ("m", -1, 10, 1), ("m", 10, 10, 1), ("m", math.nan, 10, 1), ("m", 0, math.inf, 1),
        ("m", 0, 8 * 86400, 1), ("m", 0, 10, "500ms"), ("m", 0, 10, 0.5), ("m", 1704844800, 1704844900, 1),
    ]
    for name, start, end, step in bad:
        with pytest.raises(ValueError):
            range_args(name, start, end, step, NOW)


def test_widening():
    assert widened(15, 20_000) == 32 and widened(15, 10_001) == 16


@settings(max_examples=30, deadline=None)
@given(st.integers(min_value=0, max_value=4_000_000_000_000_000))
def test_moments_are_exact(us):
    assert S.epoch_micros(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)) == us
