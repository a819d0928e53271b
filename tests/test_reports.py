"""Dashboard reports, health, targets and chart shapes on literal inputs."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from gaugeline.functions.scalars import epoch_micros
from gaugeline.operators import health, targets as T
from gaugeline.operators.rangequery import TooManyPoints
from gaugeline.plans import cold, hot, shaping

NOW = dt.datetime(2024, 1, 10)
US = 1_000_000


def points(spark, rows):
    made = [(f"{name}{labels}", name, labels, t * US, None if v is None else float(v)) for name, labels, t, v in rows]
    return spark.createDataFrame(made, "series_key string, name string, labels string, ts_us bigint, value double")


def test_throughput_from_diffs_with_a_restart(spark):
    rows = [("http_requests_total", '{"path":"/a"}', t, v) for t, v in ((0, 10), (15, 14), (30, 2), (45, 5))]
    rows += [("http_request_duration_ms_sum", "{}", t, v) for t, v in ((0, 100), (15, 124))]
    rows += [("http_request_duration_ms_count", "{}", t, v) for t, v in ((0, 10), (15, 14))]
    out = [(r["bucket_us"] // US, r["reqs"], r["avg_ms"], r["p99_ms"]) for r in hot.throughput(points(spark, rows)).collect()]
    assert out == [(15, 4.0, 6.0, None), (30, 0.0, None, None), (45, 3.0, None, None)]


def test_errors_are_range_deltas_by_path(spark):
    rows = []
    for labels, first, last in (
        ('{"path":"/a","status":"200"}', 0, 50), ('{"path":"/a","status":"500"}', 1, 4), ('{"path":"/b","status":"404"}', 9, 2),
        ('{"status":"404"}', 0, 2), ('{"path":"/ok","status":"200"}', 0, 9),
    ):
        rows += [("http_requests_total", labels, 0, first), ("http_requests_total", labels, 15, math.nan), ("http_requests_total", labels, 30, last)]
    out = [tuple(r) for r in hot.error_distribution(points(spark, rows)).collect()]
    assert out == [("/a", 0.0, 3.0, 53.0), ("(unknown)", 2.0, 0.0, 2.0)]


def test_visitor_cells_merge(spark):
    de, us = '{"region":"DE","scrape_target":"x"}', '{"region":"US","scrape_target":"x"}'
    rows = [("visitors_total", de, 0, 5), ("unique_visitors_estimate", de, 0, 3), ("visitors_total", us, 0, 7), ("unique_visitors_estimate", "{}", 15, 1), ("visitors_total", de, 15, None)]
    out = [tuple(r) for r in hot.visitors(points(spark, rows)).collect()]
    assert out == [(0, "x", "DE", 5.0, 3.0), (0, "x", "US", 7.0, None), (15 * US, "(unknown)", "(unknown)", None, 1.0)]


def test_custom_is_the_mean_over_series(spark):
    rows = [("m", "{}", 0, 10), ("m", '{"a":"1"}', 0, 30), ("m", "{}", 15, 20), ("m", '{"a":"1"}', 15, math.inf)]
    assert [(r["v"], r["n"]) for r in hot.custom(points(spark, rows)).collect()] == [(20.0, 2), (20.0, 1)]


def test_summary(spark):
    t = spark.createDataFrame([(10.0, 20.0), (30.0, 10.0), (0.0, None)], "reqs double, avg_ms double")
    e = spark.createDataFrame([(1, 3)], "c4xx bigint, c5xx bigint")
    assert tuple(cold.summary(t, e, 15).first()) == (40.0, 12.5, 2.0, 0.1, 4.0)
    assert tuple(cold.summary(t.limit(0), e.limit(0), 15).first()) == (0.0, None, 0.0, 0.0, 0.0)
    assert cold.summary(t, e, 0).first()["peak_per_sec"] == 30.0


def test_plans():
    now = epoch_micros(NOW)
    day = 86_400 * US
    wide = hot.plan_from_span(now - 30 * day, now, "24h", now)
    assert (wide.start_us, wide.end_us, wide.step, wide.covered_us) == (now - day, now, 360, day)
    short = hot.plan_from_span(now - 600 * US, now - 60 * US, "24h", now)
    assert (short.start_us, short.step) == (now - 600 * US, 15)
    empty = hot.plan_from_span(None, None, "1h", now)
    assert (empty.start_us, empty.end_us, empty.step) == (now - 3600 * US, now, 15)
    assert hot.plan_from_span(now, now, "1h", now).step == 15 and hot.window_seconds("all") == 7 * 86_400


def ring_rows(spark, seconds):
    rows = [(i, NOW - dt.timedelta(seconds=600) + dt.timedelta(seconds=s), "http_requests_total", float(i), '{"status":"500"}') for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, name string, value double, labels string")


def test_whole_seconds_leave_out_a_newest_scrape_between_seconds(spark):
    rows = ring_rows(spark, [0, 15, 30.5])
    kept = hot.dashboard_points(rows, hot.plan_window(rows, "1h", NOW, whole_seconds=True))
    exact = hot.dashboard_points(rows, hot.plan_window(rows, "1h", NOW))
    assert (kept.count(), exact.count()) == (2, 3)


def test_dashboard_raises_beyond_a_cap_and_drops_nothing(spark):
    rows = ring_rows(spark, range(0, 600, 5))
    plan = hot.plan_window(rows, "1h", NOW)
    with pytest.raises(TooManyPoints):
        hot.dashboard_points(rows, plan, max_points=10)
    many = [(1000 + i, NOW - dt.timedelta(seconds=300), "visitors_total", 1.0, f'{{"region":"r{i}"}}') for i in range(40)]
    both = rows.unionByName(spark.createDataFrame(many, rows.schema))
    with pytest.raises(TooManyPoints):
        hot.dashboard_points(both, plan, max_points=39)
    assert hot.visitors(hot.dashboard_points(both, plan)).count() == 40
    d = hot.dashboard(rows, "1h", NOW)
    assert d["summary"].first()["error_count"] > 0 and [r["name"] for r in d["names"].collect()] == ["http_requests_total"]


def cold_rows(spark, rows):
    made = [(NOW - dt.timedelta(minutes=m), name, v, "counter", labels) for m, name, v, labels in rows]
    return spark.createDataFrame(made, "ts timestamp_ntz, name string, value double, metric_type string, labels string")


def test_buckets_without_requests_still_appear(spark):
    m = cold_rows(spark, [(30, "queue_depth", 1.0, "{}"), (10, "http_requests_total", 1.0, "{}"), (10, "http_request_duration_ms", 4.0, "{}"), (90, "http_requests_total", 1.0, "{}")])
    out = [(r["reqs"], r["avg_ms"], r["p99_ms"]) for r in cold.throughput_latency(m, "1h", NOW).collect()]
    assert out == [(0, None, None), (1, 4.0, 4.0)]


def test_latest_visitors_skip_rows_without_a_value(spark):
    labels = '{"region":"DE"}'
    m = cold_rows(spark, [(3, "visitors_total", 5.0, labels), (2, "visitors_total", None, labels), (1, "unique_visitors_estimate", 2.0, labels)])
    assert tuple(cold.visitors_by_region(m, "all", NOW).first())[1:] == ("(unknown)", "DE", 5.0, 2.0)


def test_unknown_aggregation_means_avg(spark):
    m = cold_rows(spark, [(5, "m", 1.0, "{}"), (5, "m", 3.0, "{}")])
    assert cold.custom_series(m, "m", "24h", NOW, "median").first()["v"] == 2.0
    assert cold.custom_series(m, "m", "24h", NOW, "p50", approx=True).first()["v"] in (1.0, 3.0)


def test_summary_counts_errors_of_all_paths(spark):
    rows = [(1, "http_requests_total", 1.0, f'{{"path":"/{i:02d}","status":"500"}}') for i in range(30)]
    d = cold.dashboard(cold_rows(spark, rows), "all", NOW)
    assert d["errors"].count() == 20 and tuple(d["summary"].first())[-2:] == (1.0, 30.0) and not d["names_cut"].first()[0]
    first = [(i, NOW - dt.timedelta(seconds=60), "http_requests_total", 0.0, f'{{"path":"/{i}","status":"500"}}') for i in range(30)]
    last = [(100 + i, NOW - dt.timedelta(seconds=10), n, 1.0, labels) for i, _, n, _, labels in first]
    hot_rows = spark.createDataFrame(first + last, "seq bigint, ts timestamp_ntz, name string, value double, labels string")
    d = hot.dashboard(hot_rows, "1h", NOW)
    assert d["errors"].count() == 20 and tuple(d["summary"].first())[-2:] == (1.0, 30.0)


def test_top_errors_take_twenty_and_break_ties_by_path(spark):
    rows = [(1, "http_requests_total", 1.0, f'{{"path":"/{i:02d}","status":"500"}}') for i in range(25)]
    out = cold.error_distribution(cold_rows(spark, rows), "all", NOW).collect()
    assert [r["path"] for r in out] == [f"/{i:02d}" for i in range(20)]


def test_chart_shapes(spark):
    t = spark.createDataFrame([(1999, 1.0, 1.006, None), (2000, 2.0, None, 7.126)], "bucket_us bigint, reqs double, avg_ms double, p99_ms double")
    assert sorted(map(tuple, shaping.latency_series(t).select("series", "ms", "value").collect())) == [("avg", 1, 1.01), ("p99", 2, 7.13)]
    assert [tuple(r) for r in shaping.throughput_series(t).collect()] == [(1, 1.0), (2, 2.0)]


# Health.

def outcomes(spark, rows):
    made = [(i, NOW + dt.timedelta(seconds=i), t, s, n, 5) for i, (t, s, n) in enumerate(rows)]
    return spark.createDataFrame(made, "attempt_seq bigint, ts timestamp_ntz, target string, status string, samples bigint, duration_ms bigint")


def registry(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, mode string, enabled boolean")


def test_status_walk(spark):
    o = outcomes(spark, [("a", "ok", 9), ("a", "fetch_error", 0), ("a", "parse_error", 0), ("b", "fetch_error", 0), ("b", "ok", 3), ("gone", "fetch_error", 0)])
    known = registry(spark, ("a", "recurring", True), ("b", "once", False), ("c", "recurring", True))
    out = {r["target"]: r for r in health.target_status(o, known).collect()}
    assert set(out) == {"a", "b", "c"}
    assert (out["a"]["last_status"], out["a"]["last_samples"], out["a"]["consecutive_failures"]) == ("parse_error", 0, 2)
    assert (out["a"]["ok"], out["a"]["fetch_error"], out["a"]["parse_error"]) == (1, 1, 1)
    assert (out["b"]["last_status"], out["b"]["last_samples"], out["b"]["consecutive_failures"]) == ("ok", 3, 0)
    assert out["c"]["last_status"] is None and out["c"]["ok"] == 0


@pytest.mark.parametrize("rows, known, state", [
    ([("a", "ok", 1)], [("a", "recurring", True)], "ok"),
    ([("a", "ok", 1)], [("a", "recurring", True), ("b", "recurring", True)], "starting"),
    ([("a", "ok", 1)], [("a", "recurring", True), ("b", "recurring", False), ("c", "once", True)], "ok"),
    ([("a", "fetch_error", 0)], [("a", "recurring", False), ("b", "recurring", True)], "degraded"),
])
def test_collector_health(spark, rows, known, state):
    assert health.collector_health(health.target_status(outcomes(spark, rows), registry(spark, *known))).first()["status"] == state


def test_jobs(spark):
    rows = [(i, s, f) for i, (s, f) in enumerate([("done", 5), ("failed", 5), ("pending", None), ("running", None), ("cancelled", 3), ("done", 9)])]
    jobs = spark.createDataFrame(rows, "job_id bigint, state string, finished_at bigint")
    s = health.job_summary(jobs, paused=True).first()
    assert (s["depth"], s["running"], s["done"], s["failed"], s["paused"], s["frozen"]) == (1, 1, 2, 1, True, False)
    assert [r["job_id"] for r in health.recent_jobs(jobs, 3).collect()] == [5, 1, 0]


# Targets.

def test_overrides_and_tombstones(spark):
    config = spark.createDataFrame([(f"cfg:{n}", n, f"http://{n}", "recurring", True) for n in "abcd"], "id string, name string, url string, mode string, enabled boolean")
    dynamic = spark.createDataFrame([("cfg:z", "z", "http://z", "once", False)], config.schema)
    log = [("cfg:a", 1, "disable"), ("cfg:b", 1, "disable"), ("cfg:b", 2, "remove"), ("cfg:c", 1, "remove"), ("cfg:c", 2, "enable"), ("cfg:z", 1, "enable")]
    events = spark.createDataFrame(log, "id string, seq bigint, op string")
    out = {r["name"]: (r["origin"], r["enabled"]) for r in T.effective_targets(config, dynamic, events).collect()}
    assert out == {"a": ("config", False), "c": ("config", True), "d": ("config", True), "z": ("dynamic", False)}


def test_quality_checks(spark):
    rows = [
        ("1", "a", "http://a", "config"), ("2", "a", "http://b", "dynamic"), ("3", "c", "http://c", "dynamic"), ("4", "c", " http://c ", "dynamic"),
        ("5", " ", "ftp://x", "dynamic"), ("6", "e", "http://e e", "dynamic"), ("7", "f", "", "dynamic"),
    ]
    df = spark.createDataFrame(rows, "id string, name string, url string, origin string")
    out = sorted((r["reason"], r["subject"], r["n"]) for r in T.quality_checks(df, max_dynamic=5).collect())
    assert out == [
        ("bad_url", "", 1), ("bad_url", "ftp://x", 1), ("bad_url", "http://e e", 1), ("blank_name", "5", 1), ("duplicate_name", "c", 2),
        ("duplicate_url", "http://c", 2), ("name_conflicts_with_config", "a", 2), ("too_many_dynamic", "dynamic", 6),
    ]


def test_normalise_keeps_missing_measures(spark):
    df = spark.createDataFrame([(None, None, None)], "path string, reqs bigint, avg_ms double")
    assert tuple(cold.normalise(df).first()) == ("(unknown)", 0, None)
