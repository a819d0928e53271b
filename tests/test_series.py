"""Differences, totals, quantiles, range queries and the recent window, against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.functions.scalars import epoch_micros
from gaugeline.operators import quantiles, rangequery as R, ring
from gaugeline.operators.series import DAY_US, MEASURED, chunk_width, counter_diffs, first_last_delta, running_total

BASE = dt.datetime(2024, 1, 1)
BASE_US = epoch_micros(BASE)


def points(spark, rows):
    return spark.createDataFrame(rows, "series_key string, ts_us bigint, seq bigint, value double")


def plain_diffs(rows):
    out = []
    by_key = {}
    for key, ts, seq, value in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        v = value if value is not None and math.isfinite(value) else None
        before = by_key.get(key)
        if before is not None and v is not None:
            out.append((key, ts, seq, max(0.0, v - before)))
        by_key[key] = v
    return sorted(out)


@pytest.mark.parametrize("chunk", [None, 1000, 7, 10**9, MEASURED])
def test_diffs_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(5)
    # One hot series, gaps longer than a chunk, repeated timestamps, resets and missing values.
    rows = []
    for seq in range(600):
        key = "hot" if rng.random() < 0.7 else f"s{rng.randrange(5)}"
        value = rng.choice([math.nan, None, math.inf]) if rng.random() < 0.15 else float(rng.randrange(100))
        rows.append((key, rng.randrange(300) * (50 if rng.random() < 0.1 else 1), seq, value))
    out = counter_diffs(points(spark, rows), seq="seq", chunk_us=chunk)
    assert sorted((r["series_key"], r["ts_us"], r["seq"], r["diff"]) for r in out.collect()) == plain_diffs(rows)


def test_a_gap_is_not_bridged_and_a_restart_counts_zero(spark):
    rows = [("a", t, t, v) for t, v in enumerate([1.0, 5.0, math.nan, 9.0, 2.0, 4.0])]
    out = counter_diffs(points(spark, rows), seq="seq").orderBy("ts_us").collect()
    assert [(r["ts_us"], r["diff"]) for r in out] == [(1, 4.0), (4, 0.0), (5, 2.0)]


def test_chunks_narrow_until_the_fullest_fits(spark):
    # Half of the day's rows lie in its first second.
    rows = [("a", i, i, 1.0) for i in range(500)] + [("a", 1_000_000 + i * 10**8, i, 1.0) for i in range(500)]
    df = points(spark, rows)
    width = chunk_width(df, ["series_key"], limit=100)
    assert width <= 100 and chunk_width(df, ["series_key"]) == DAY_US
    assert chunk_width(points(spark, [("a", 5, i, 1.0) for i in range(9)]), ["series_key"], limit=3) == 1


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_total(spark, width):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i * rng.randrange(1, 4) + i * 5, rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    sums, expected = {}, []
    for k, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        sums[k] = sums.get(k, 0) + v
        expected.append((k, o, sums[k]))
    out = running_total(df, ["k"], "o", "v", width)
    assert sorted((r["k"], r["o"], r["running"]) for r in out.collect()) == sorted(expected)


def test_first_last_delta_is_clamped(spark):
    rows = [("a", 1, 1, 5.0), ("a", 2, 2, math.nan), ("a", 3, 3, 8.0), ("b", 1, 1, 5.0), ("b", 2, 2, 1.0), ("c", 1, 1, math.nan)]
    out = {r["series_key"]: r["delta"] for r in first_last_delta(points(spark, rows)).collect()}
    assert out == {"a": 3.0, "b": 0.0}


def interpolated(values, p):
    ordered = sorted(values)
    at = (len(ordered) - 1) * p
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("direct", [1, 2**22])
def test_quantiles_match_plain_sorting(spark, direct):
    rng = random.Random(3)
    data = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(101)],
        "narrow": [1 + rng.randrange(1000) * 2**-50 for _ in range(200)],
        "same": [4.5] * 50, "one": [-2.0], "zeros": [0.0, -0.0, 1.0, -1.0], "tiny": [5e-324, 1e-310, -5e-324],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    out = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "v", wanted, direct_rows=direct).collect()}
    assert set(out) == set(data)
    for key, values in data.items():
        for name, p in wanted.items():
            assert out[key][name] == pytest.approx(interpolated(values, p), rel=1e-12, abs=0), (key, name)


def test_quantiles_sort_specials_like_the_engine(spark):
    rows = [("a", v) for v in (1.0, math.nan, -math.inf, math.inf, 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    row = quantiles.exact_quantiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p75": 0.75, "p100": 1.0}).first()
    assert (row["p0"], row["p50"], row["p75"]) == (-math.inf, 1.0, math.inf) and math.isnan(row["p100"])


def samples(spark, rows):
    made = [(seq, BASE + dt.timedelta(seconds=s), name, float(v), labels) for seq, (s, name, v, labels) in enumerate(rows)]
    return spark.createDataFrame(made, "seq bigint, ts timestamp_ntz, name string, value double, labels string")


A, B = '{"path":"/a"}', '{"path":"/b"}'


def test_bucket_winners_and_empty_answers(spark):
    df = samples(spark, [(0, "m", 1, A), (5, "m", 2, A), (10, "m", 3, A), (5, "m", 9, B), (5, "n", 7, A), (5, "m", 4, A)])
    q = R.range_args("m", BASE, BASE + dt.timedelta(seconds=10), 10, BASE + dt.timedelta(days=1))
    out = sorted((r["series_key"], r["bucket"], r["ts_us"] - BASE_US, r["value"]) for r in R.query_range(df, q).collect())
    # The later arrival wins on an equal time, both ends are inside, and the stamp is the sample's own.
    assert out == [('m{"path":"/a"}', 0, 5_000_000, 4.0), ('m{"path":"/a"}', 1, 10_000_000, 3.0), ('m{"path":"/b"}', 0, 5_000_000, 9.0)]
    none = R.range_args("nope", BASE, BASE + dt.timedelta(seconds=10), 10, BASE + dt.timedelta(days=1))
    assert R.query_range(df, none).count() == 0


def test_too_many_points_is_an_error_and_widening_resolves_it(spark):
    df = samples(spark, [(i, "m", i, A) for i in range(100)])
    q = R.range_args("m", BASE, BASE + dt.timedelta(seconds=99), 1, BASE + dt.timedelta(days=1))
    with pytest.raises(R.TooManyPoints, match="100 points"):
        R.query_range(df, q, max_points=50)
    held, used = R.query_range_adaptive(df, q, max_points=50)
    assert used.step_us == 3_000_000 and held.count() == 34
    with pytest.raises(R.TooManyPoints):
        R.query_range_adaptive(df, q, max_points=1, retries=0)


def test_coverage(spark):
    df = samples(spark, [(10, "m", 1, A), (0, "n", 1, A)])
    assert R.coverage_warning(df, BASE_US + 9_000_000).first()[0] is True
    assert R.coverage_warning(df, BASE_US + 10_000_000).first()[0] is False
    assert R.coverage_warning(df.limit(0), 0).first()[0] is False


@pytest.mark.parametrize("cap", [1, 2, 7, 50, 500])
def test_newest_samples(spark, cap):
    rng = random.Random(cap)
    seqs = rng.sample(range(10**6), 60) + [10**9 + i for i in range(20)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint")
    assert sorted(r["seq"] for r in ring.keep_newest(df, cap).collect()) == sorted(seqs)[-cap:]
    assert ring.keep_newest(df.limit(0), cap).count() == 0


def test_evictions_match_a_simulated_ring(spark):
    rng = random.Random(9)
    pushes = [(rng.choice("abc"), i * 3, rng.randrange(0, 9)) for i in range(60)]
    size, lost = 0, {}
    for target, _, n in pushes:
        over = max(0, size + n - 20)
        size = size + n - over
        if over:
            lost[target] = lost.get(target, 0) + over
    df = spark.createDataFrame(pushes, "target string, seq bigint, n bigint")
    assert {r["target"]: r["dropped"] for r in ring.eviction_counts(df, 20).collect()} == lost


def test_span_names_and_occupancy(spark):
    df = samples(spark, [(3, "b", 1, A), (1, "a", 1, A), (2, "b", 1, A)])
    span = ring.buffer_span(df).first()
    assert (span["oldest_us"] - BASE_US, span["newest_us"] - BASE_US) == (3_000_000, 2_000_000)
    assert ring.buffer_span(df.limit(0)).first()["oldest_us"] is None
    assert [r["name"] for r in ring.metric_names(df).collect()] == ["a", "b"]
    assert ring.buffer_occupancy(df, 5).first() == (3, 5)


def test_counts_do_not_change_under_repartition(spark):
    df = samples(spark, [(i, "m", i % 7, A if i % 3 else B) for i in range(200)])
    q = R.range_args("m", BASE, BASE + dt.timedelta(seconds=300), 20, BASE + dt.timedelta(days=1))
    runs = [sorted(map(tuple, R.query_range(d, q).select("series_key", "bucket", "value").collect())) for d in (df, df.repartition(7), df.orderBy(F.rand(1)))]
    assert runs[0] == runs[1] == runs[2]
    assert len({r[:2] for r in runs[0]}) == len(runs[0])
