"""Streams give what the batch operators give, also when a batch runs twice."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from gaugeline.functions.scalars import micros
from gaugeline.operators import health
from gaugeline.operators.series import counter_diffs
from gaugeline.session import work_dir
from gaugeline.streaming import streams as S

NOW = dt.datetime(2024, 1, 10)
SCHEMA = "seq bigint, ts timestamp_ntz, name string, value double, labels string, series_key string"


def land(spark, batches, schema):
    base = work_dir(spark, "stream")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/p{i}")
    return base, spark.createDataFrame([], schema)


def sample(seq, second, value, key="k"):
    return (seq, NOW + dt.timedelta(seconds=second), "m", value, "{}", key)


BATCHES = [
    [sample(0, 0, 1.0), sample(1, 5, 4.0), sample(2, 5, 7.0, "z")],
    [sample(3, 10, 2.0), sample(4, 3, 99.0), sample(5, 15, math.nan)],
    [sample(6, 20, 8.0), sample(7, 25, 9.0), sample(8, 20, 10.0, "z")],
]


def test_diffs_cross_batches_and_late_rows_are_counted(spark):
    base, like = land(spark, BATCHES, SCHEMA)
    S.stream_counter_diffs(S.read_files(spark, f"{base}/in/*", like), f"{base}/out", f"{base}/state", f"{base}/cp").awaitTermination()
    out = sorted(map(tuple, spark.read.parquet(f"{base}/out/diffs").select("series_key", "ts_us", "diff").collect()))
    rows = [r for b in BATCHES for r in b if r[0] != 4]
    batch = spark.createDataFrame(rows, SCHEMA).select("series_key", micros("ts").alias("ts_us"), "seq", "value")
    assert out == sorted(map(tuple, counter_diffs(batch, seq="seq").select("series_key", "ts_us", "diff").collect()))
    assert [r["count"] for r in spark.read.parquet(f"{base}/out/late").collect()] == [1]


def test_recent_window_and_latest_series(spark):
    base, like = land(spark, BATCHES, SCHEMA)
    S.stream_recent(S.read_files(spark, f"{base}/in/*", like), f"{base}/state", f"{base}/cp", 4).awaitTermination()
    assert sorted(r["seq"] for r in S.current_state(spark, f"{base}/state").collect()) == [5, 6, 7, 8]
    S.stream_latest_series(S.read_files(spark, f"{base}/in/*", like), f"{base}/out", f"{base}/cp2").awaitTermination()
    assert {r["series_key"]: r["value"] for r in S.latest_series(spark, f"{base}/out").collect()} == {"k": 9.0, "z": 10.0}


OUTCOMES = "seq bigint, attempt_seq bigint, ts timestamp_ntz, target string, status string, samples bigint, duration_ms bigint"


def outcome(i, target, status):
    return (i, i, NOW + dt.timedelta(seconds=i), target, status, i * 2, i)


def test_target_status_folds_to_the_batch_result(spark):
    batches = [
        [outcome(0, "a", "ok"), outcome(1, "b", "fetch_error")], [outcome(2, "a", "fetch_error"), outcome(3, "b", "parse_error")],
        [outcome(4, "b", "fetch_error"), outcome(5, "c", "ok"), outcome(6, "a", "ok"), outcome(7, "a", "parse_error")],
    ]
    base, like = land(spark, batches, OUTCOMES)
    S.stream_target_status(S.read_files(spark, f"{base}/in/*", like), f"{base}/state", f"{base}/cp").awaitTermination()
    out = S.current_state(spark, f"{base}/state")
    whole = spark.createDataFrame([r for b in batches for r in b], OUTCOMES)
    assert {(r["target"], r["last_attempt"], r["late"]) for r in out.collect()} == {("a", 7, 0), ("b", 4, 0), ("c", 5, 0)}
    out = out.drop("last_attempt", "late")
    expected = health.outcome_rollup(whole).join(health.failure_streak(whole), "target").select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, expected.collect()))
    assert {r["target"]: r["consecutive_failures"] for r in out.collect()} == {"a": 1, "b": 3, "c": 0}


def test_a_late_attempt_changes_nothing_but_its_count(spark):
    state = work_dir(spark, "late")
    batches = [[outcome(5, "a", "ok")], [outcome(3, "a", "fetch_error"), outcome(4, "b", "fetch_error")], [outcome(6, "a", "timeout"), outcome(5, "a", "ok")]]
    for i, rows in enumerate(batches):
        S._keep(S.fold_status(S._previous(spark, state, i), spark.createDataFrame(rows, OUTCOMES)), state, i)
    out = {r["target"]: r for r in S.current_state(spark, state).collect()}
    assert (out["a"]["last_status"], out["a"]["last_attempt"], out["a"]["consecutive_failures"], out["a"]["ok"], out["a"]["other"], out["a"]["late"]) == (None, 6, 1, 1, 1, 2)
    assert (out["b"]["last_status"], out["b"]["late"]) == ("fetch_error", 0)


def test_equal_times_across_batches_follow_arrival(spark):
    rows = [[sample(0, 0, 1.0), sample(1, 5, 4.0)], [sample(2, 5, 6.0), sample(3, 5, 7.0)], [sample(1, 5, 9.0)]]
    base, like = land(spark, rows, SCHEMA)
    S.stream_counter_diffs(S.read_files(spark, f"{base}/in/*", like), f"{base}/out", f"{base}/state", f"{base}/cp").awaitTermination()
    assert sorted(r["diff"] for r in spark.read.parquet(f"{base}/out/diffs").collect()) == [1.0, 2.0, 3.0]
    assert [r["count"] for r in spark.read.parquet(f"{base}/out/late").collect()] == [1]


def test_a_repeated_state_batch_changes_nothing(spark):
    state = work_dir(spark, "slots")
    first, second = (spark.createDataFrame([outcome(i, "a", "fetch_error")], OUTCOMES) for i in (0, 1))
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        S._keep(S.fold_status(S._previous(spark, state, batch_id), batch), state, batch_id)
    assert S.current_state(spark, state).first()["consecutive_failures"] == 2


def test_windows_close_with_the_watermark(spark):
    schema = "ts timestamp_ntz, name string, value double"
    rows = [[(NOW + dt.timedelta(minutes=m), "http_requests_total", 1.0) for m in (0, 10, 70)], [(NOW + dt.timedelta(minutes=200), "http_request_duration_ms", 3.0)]]
    base, like = land(spark, rows, schema)
    query = S.stream_throughput(S.read_files(spark, f"{base}/in/*", like), f"{base}/out", f"{base}/cp", approx_p99=True)
    query.awaitTermination()
    assert sorted(r["reqs"] for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2]
    assert spark.read.parquet(f"{base}/out").columns == ["bucket_us", "reqs", "avg_ms", "p99_ms"] and S.dropped_by_watermark(query) == 0


def test_replayed_payloads_are_dropped(spark):
    schema = "scrape_id string, scrape_ts timestamp_ntz"
    rows = [[("a", NOW), ("b", NOW)], [("a", NOW), ("c", NOW + dt.timedelta(minutes=1))]]
    base, like = land(spark, rows, schema)
    unique = S.dedupe_payloads(S.read_files(spark, f"{base}/in/*", like))
    S.write_stream(unique, f"{base}/out", f"{base}/cp").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    assert sorted(r["scrape_id"] for r in out.select("scrape_id").collect()) == ["a", "b", "c"] and out.filter(F.col("scrape_ts").isNull()).count() == 0
