"""Every row of a stream is used, held back or kept aside; state grows with the batch; sketches merge."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from gaugeline.functions.scalars import micros
from gaugeline.operators import sketches as K
from gaugeline.operators.series import counter_diffs
from gaugeline.session import work_dir
from gaugeline.streaming import streams as S

NOW = dt.datetime(2024, 1, 10)
SCHEMA = "seq bigint, ts timestamp_ntz, name string, value double, labels string, series_key string"
SECOND = 1_000_000


def sample(seq, second, value, key="k"):
    return (seq, None if second is None else NOW + dt.timedelta(seconds=second), "m", value, "{}", key)


def land(spark, batches, schema):
    base = work_dir(spark, "places")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/p{i}")
    return base, S.read_files(spark, f"{base}/in/*", spark.createDataFrame([], schema))


def differences(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).select("series_key", micros("ts").alias("ts_us"), "seq", "value")
    return sorted(map(tuple, counter_diffs(table, seq="seq").select("series_key", "ts_us", "diff").collect()))


def test_shuffled_samples_give_the_differences_of_sorted_ones(spark):
    rng = random.Random(4)
    rows = [sample(i, i // 3, float(rng.randint(0, 50)), "ab"[i % 2]) for i in range(90)]
    arrived = sorted(rows, key=lambda r: (r[1] - NOW).total_seconds() + rng.random() * 10)
    batches = [arrived[:30], arrived[30:60], [*arrived[60:], sample(900, 1, 9.0, "a"), sample(901, None, 1.0, "b"), sample(902, 500, 3.0, "c")], [sample(903, None, 2.0)]]
    base, stream = land(spark, batches, SCHEMA)
    S.stream_counter_diffs(stream, f"{base}/out", f"{base}/state", f"{base}/cp", delay_us=10 * SECOND).awaitTermination()
    like = spark.createDataFrame([], SCHEMA)
    held = S.current_state(spark, f"{base}/state/held").count()
    S.finish_counter_diffs(like, f"{base}/out", f"{base}/state")
    S.finish_counter_diffs(like, f"{base}/out", f"{base}/state")  # nothing is left
    out = sorted(map(tuple, spark.read.parquet(f"{base}/out/diffs").select("series_key", "ts_us", "diff").collect()))
    assert held > 0 and out == differences(spark, [*rows, sample(902, 500, 3.0, "c")])
    aside = spark.read.parquet(f"{base}/out/aside")
    assert {(r["seq"], r["reason"], r["value"], r["labels"]) for r in aside.collect()} == {(900, "late", 9.0, "{}"), (901, "no_time", 1.0, "{}"), (903, "no_time", 2.0, "{}")}


def test_a_repeated_difference_batch_changes_nothing_and_changes_are_merged(spark):
    base = work_dir(spark, "again")
    work = S.diff_batch(f"{base}/out", f"{base}/state", merge=2)
    rows = [[sample(3 * b + j, 10 * b + j, float(b * j), "xyz"[j]) for j in range(3) if (b + j) % 2] for b in range(6)]
    for batch_id in (0, 1, 1, 2, 2, 3, 4, 4, 5):
        work(spark.createDataFrame(rows[batch_id], SCHEMA), batch_id)
    out = sorted(map(tuple, spark.read.parquet(f"{base}/out/diffs").select("series_key", "ts_us", "diff").collect()))
    assert out == differences(spark, [r for b in rows for r in b])
    assert S._finished(spark, f"{base}/state/last", "merged") == [1, 3] and S._finished(spark, f"{base}/state/last", "batch") == [2, 3, 4, 5]


def test_the_latest_value_writes_the_series_of_the_batch(spark):
    state = work_dir(spark, "latest")
    work = S.latest_batch(state, merge=3)
    everything = [sample(i, i, float(i), f"s{i}") for i in range(200)]
    for batch_id, rows in enumerate([everything, [sample(300, 900, 1.0, "s7")], [sample(301, 2, 5.0, "s7"), sample(302, 800, 6.0, "s8")], [], [sample(303, 901, 2.0, "s7")]]):
        work(spark.createDataFrame(rows, SCHEMA), batch_id)
    assert [spark.read.parquet(f"{state}/batch-{b}").count() for b in (1, 2, 3, 4)] == [1, 2, 0, 1]
    assert S._finished(spark, state, "merged") == [2] and spark.read.parquet(f"{state}/merged-2").count() == 200
    found = {r["series_key"]: r["value"] for r in S.latest_series(spark, state).collect()}
    assert len(found) == 200 and (found["s7"], found["s8"], found["s9"]) == (2.0, 6.0, 9.0)


def test_in_time_and_late_are_all(spark):
    schema = "ts timestamp_ntz, name string, value double"
    rng = random.Random(9)
    batches = [[(None if rng.random() < 0.1 else NOW + dt.timedelta(minutes=20 * b + rng.randint(-300, 5)), "http_requests_total", 1.0) for _ in range(20)] for b in range(8)]
    base, stream = land(spark, batches, schema)
    S.stream_split(stream, f"{base}/out", f"{base}/cp", delay_us=3600 * SECOND, width_us=3600 * SECOND).awaitTermination()
    late, ontime = spark.read.parquet(f"{base}/out/late"), spark.read.parquet(f"{base}/out/ontime")
    assert late.count() + ontime.count() == 160
    expected, top = {"late": 0, "no_time": 0}, None
    for rows in batches:
        for ts, *_ in rows:
            if ts is None:
                expected["no_time"] += 1
            elif top is not None and ts.replace(minute=0, second=0) + dt.timedelta(hours=1) <= top - dt.timedelta(hours=1):
                expected["late"] += 1
        top = max([t for t, *_ in rows if t] + ([top] if top else []))
    assert {r["reason"]: r["count"] for r in late.groupBy("reason").count().collect()} == expected and expected["late"] > 10
    like = spark.createDataFrame([], schema)
    query = S.stream_throughput(S.read_ontime(spark, f"{base}/out", like, 1), f"{base}/windows", f"{base}/cp2", sketch_k=200)
    query.awaitTermination()
    assert S.dropped_by_watermark(query) == 0
    windows = spark.read.parquet(f"{base}/windows")
    closed = {r["bucket_us"]: r["reqs"] for r in windows.collect()}
    counted = {r["b"]: r["n"] for r in ontime.groupBy(F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert closed and all(counted[b] == n for b, n in closed.items())


def test_a_late_first_arrival_is_kept_aside(spark):
    schema = "scrape_id string, scrape_ts timestamp_ntz"
    batches = [[("a", NOW), ("b", NOW)], [("a", NOW), ("c", NOW - dt.timedelta(hours=2))], [("d", NOW + dt.timedelta(minutes=1))]]
    base, stream = land(spark, batches, schema)
    S.stream_split(stream, f"{base}/out", f"{base}/cp", time="scrape_ts").awaitTermination()
    assert [(r["scrape_id"], r["reason"]) for r in spark.read.parquet(f"{base}/out/late").collect()] == [("c", "late")]
    unique = S.dedupe_payloads(S.read_ontime(spark, f"{base}/out", spark.createDataFrame([], schema), 1))
    S.write_stream(unique, f"{base}/unique", f"{base}/cp2").awaitTermination()
    assert sorted(r["scrape_id"] for r in spark.read.parquet(f"{base}/unique").collect()) == ["a", "b", "d"]


OUTCOMES = "attempt_seq bigint, ts timestamp_ntz, target string, status string, samples bigint, duration_ms bigint"


def test_every_attempt_is_counted_late_or_unordered(spark):
    rng = random.Random(6)
    log = [(None if rng.random() < 0.1 else i, NOW, rng.choice(["a", "b", None]), rng.choice(["ok", "fetch_error", "odd"]), 1, 1) for i in range(120)]
    rng.shuffle(log)
    state, aside = work_dir(spark, "state"), work_dir(spark, "aside")
    work = S.status_batch(state, aside)
    for batch_id in (0, 1, 1, 2):
        work(spark.createDataFrame(log[batch_id * 40 : batch_id * 40 + 40], OUTCOMES), batch_id)
    kept = spark.read.parquet(aside)
    states = ("ok", "fetch_error", "parse_error", "other")
    total = {r["target"]: (sum(r[c] for c in states), r["late"]) for r in S.current_state(spark, state).filter("target IS NOT NULL").collect()}
    assert kept.filter("reason = 'unordered'").count() == sum(r[0] is None for r in log)
    for target in ("a", "b"):
        top, expected = None, [0, 0]
        for batch in (log[:40], log[40:80], log[80:]):
            mine = [r[0] for r in batch if r[2] == target]
            used = [n for n in mine if n is not None and (top is None or n > top)]
            expected = [expected[0] + len(used), expected[1] + len(mine) - len(used)]
            top = max([*used, *([] if top is None else [top])], default=None)
        assert total[target] == tuple(expected) and kept.filter(F.col("target") == target).count() == expected[1] > 0


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(8)
    rows = [(i % 24, rng.lognormvariate(3, 1)) for i in range(40_000)] + [(0, float("nan")), (0, None), (1, float("inf"))]
    df = spark.createDataFrame(rows, "hour int, value double")
    day = K.widen(K.sketch_buckets(df, ["hour"]).repartition(5), [F.lit("all").alias("g")])
    values = sorted(v for _, v in rows if v is not None and v == v and v != float("inf"))
    for p in (0.5, 0.9, 0.99):
        found = day.select("n", K.quantile_of("sketch", p).alias("q")).first()
        rank = sum(v <= found["q"] for v in values) / len(values)
        assert found["n"] == 40_000 and abs(rank - p) <= 2 * K.rank_error()
