"""Inputs that once lost or doubled rows: dirty registries, unreadable labels, null groups, missing arrival numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gaugeline.functions.labels import is_malformed
from gaugeline.functions.scalars import micros
from gaugeline.operators import health, ingest as I, rangequery as R, ring, targets as T
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.operators.series import first_last_delta
from gaugeline.plans import cold
from gaugeline.sources import sinks

NOW = dt.datetime(2024, 1, 10)


def payloads(spark, targets, body="http_x 1\nvisitors_y 2\n"):
    rows = [(f"s{i}", t, NOW, i, 200, body) for i, t in enumerate(targets)]
    return spark.createDataFrame(rows, "scrape_id string, target string, scrape_ts timestamp_ntz, seq long, http_status int, body string")


def test_a_name_registered_twice_stores_each_sample_once(spark):
    known = spark.createDataFrame([("a", ["http_"]), ("a", ["visitors_"]), ("b", []), ("b", [])], "name string, allow array<string>")
    rows = payloads(spark, ["a", "b"])
    samples, outcomes = I.ingest(rows, known)
    assert sorted((r["target"], r["name"]) for r in samples.collect()) == [(t, n) for t in "ab" for n in ("http_x", "visitors_y")]
    assert sorted((r["target"], r["samples"]) for r in outcomes.collect()) == [("a", 2), ("b", 2)]


def test_attempts_at_unknown_targets_stay(spark):
    known = spark.createDataFrame([("a", [])], "name string, allow array<string>")
    samples, outcomes = I.ingest(payloads(spark, ["a", "gone", None]), known)
    assert samples.count() == 2
    assert sorted((str(r["target"]), r["status"], str(r["fetch_reason"]), r["samples"]) for r in outcomes.collect()) == [
        ("None", "fetch_error", "unknown_target", 0), ("a", "ok", "None", 2), ("gone", "fetch_error", "unknown_target", 0)]


def test_conflicting_additions_are_refused_in_order(spark):
    columns = "id string, name string, url string, mode string, enabled boolean"
    config = spark.createDataFrame([("cfg:a", "a", "http://a", "recurring", True), ("cfg:r", "r", "http://r", "recurring", True)], columns)
    added = [("t1", "a", "http://t1"), ("t2", "x", "http://a"), ("t3", "x", "http://t3"), ("t4", "x ", "http://t4"), ("t5", "y", " http://t4"), ("t6", "z", "http://t3"), ("t7", "r", "http://t7")]
    dynamic = spark.createDataFrame([(*t, "once", True) for t in added], columns)
    log = spark.createDataFrame([("cfg:r", 1, "remove")], "id string, seq long, op string")
    # t2 is refused for its address and takes no name; t4 is refused and leaves its address to t5
    assert sorted(r["id"] for r in T.effective_targets(config, dynamic, log).collect()) == ["cfg:a", "t3", "t5", "t7"]


def test_unreadable_labels_are_series_of_their_own(spark):
    rows = [(i, NOW, "m", float(i), x) for i, x in enumerate(["{broken", "also broken", "{}", None, " ", '{"b":"1", "a":"2"}', '{"a":"2","b":"1"}'])]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, name string, value double, labels string")
    points = R.latest_per_bucket(df, 0, 10**6)
    assert sorted((r["series_key"], r["value"]) for r in points.collect()) == [("malso broken", 1.0), ('m{"a":"2","b":"1"}', 6.0), ("m{broken", 0.0), ("m{}", 4.0)]
    assert len(set(r["value"] for r in sinks.prom_text(df).collect())) == 4
    assert df.filter(is_malformed()).count() == 2


def test_null_groups_have_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("k", 2.0), ("k", None)], "k string, v double")
    for direct in (2**22, 0):
        got = {r["k"]: r["p"] for r in exact_quantiles(df, ["k"], "v", {"p": 0.5}, direct_rows=direct).collect()}
        assert got == {None: 2.0, "k": 2.0}
    rows = spark.createDataFrame([(None, "http_request_duration_ms", 4.0, "{}"), (None, "http_requests_total", 1.0, "{}")], "ts timestamp_ntz, name string, value double, labels string")
    assert tuple(cold.throughput_latency(rows, "all", NOW).first()) == (None, 1, 4.0, 4.0)


def test_rows_without_arrival_number_are_the_oldest(spark):
    df = spark.createDataFrame([(None, NOW, "m", 1.0, "{}"), (3, NOW, "m", 2.0, "{}")], "seq long, ts timestamp_ntz, name string, value double, labels string")
    assert ring.keep_newest(df, 2).count() == 2 and ring.keep_newest(df, 1).first()["seq"] == 3
    assert R.latest_per_bucket(df, 0, 10**6).first()["value"] == 2.0
    assert R.latest_per_bucket(df.filter("seq IS NULL"), 0, 10**6).first()["value"] == 1.0


def test_equal_times_in_deltas_follow_arrival(spark):
    df = spark.createDataFrame([("k", 5, 2, 9.0), ("k", 5, 1, 4.0)], "series_key string, ts_us long, seq long, value double")
    assert first_last_delta(df, seq="seq").first()["delta"] == 5.0


def test_unlisted_states_are_counted(spark):
    rows = [(0, NOW, "a", "ok", 1, 5), (1, NOW, "a", "timeout", 0, 5), (2, NOW, "b", None, 0, 5)]
    o = spark.createDataFrame(rows, "attempt_seq long, ts timestamp_ntz, target string, status string, samples long, duration_ms long")
    known = spark.createDataFrame([("a", "once", True), ("b", "once", True)], "name string, mode string, enabled boolean")
    got = {r["target"]: (r["last_status"], r["ok"], r["other"]) for r in health.target_status(o, known).collect()}
    assert got == {"a": (None, 1, 1), "b": (None, 0, 1)}


def test_self_metrics_in_one_pass(spark):
    o = spark.createDataFrame([("a", "ok", 5, 2), ("a", "ok", 3, 0), ("a", "fetch_error", 0, 0), ("b", "ok", 0, 0)], "target string, status string, samples long, dropped long")
    rows = I.self_metrics(o, F.lit(NOW))
    got = {(r["name"], r["labels"]): r["value"] for r in rows.collect()}
    assert got == {
        ("collector_scrape_total", '{"status":"ok","target":"a"}'): 2.0, ("collector_scrape_total", '{"status":"fetch_error","target":"a"}'): 1.0,
        ("collector_scrape_total", '{"status":"ok","target":"b"}'): 1.0, ("collector_samples_stored_total", '{"target":"a"}'): 8.0,
        ("collector_samples_stored_total", '{"target":"b"}'): 0.0, ("collector_samples_dropped_total", '{"reason":"over_cap","target":"a"}'): 2.0,
    }
    assert rows.select(micros("ts")).count() == 6
