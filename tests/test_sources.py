"""Files in and out, retention, rendering, and the measured broadcast."""

from __future__ import annotations

import datetime as dt
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import grid
from gaugeline.session import broadcast_if, clear_work, small_side, work_dir
from gaugeline.sources import metrics as M, retention, sinks

NOW = dt.datetime(2024, 3, 1)


def history(spark, days):
    rows = [(NOW - dt.timedelta(days=d), "m", float(d), "gauge", "{}") for d in days]
    return spark.createDataFrame(rows, M.METRICS_SCHEMA)


def test_files_are_matched_by_name(spark):
    base = work_dir(spark, "t")
    h = history(spark, [1, 2])
    h.drop("metric_type").write.parquet(f"{base}/metrics_cold_1.parquet")
    h.select("labels", "value", "name", "ts", "metric_type", F.lit(1).alias("extra")).write.parquet(f"{base}/metrics_cold_2.parquet")
    paths = M.resolve_paths(spark, base)
    assert [os.path.basename(p) for p in paths] == ["metrics_cold_1.parquet", "metrics_cold_2.parquet"]
    df = M.read_metrics(spark, paths, extra=True)
    assert df.count() == 4 and df.filter("metric_type IS NULL AND extra IS NULL").count() == 2
    assert M.read_metrics(spark, paths, extra=False).columns == [f.name for f in M.METRICS_SCHEMA]
    assert M.read_metrics(spark, paths[0], extra=True).columns[-1] == "metric_type"


def test_resolving_sources(spark):
    assert M.resolve_paths(spark, " /x/y.PARQUET/ ") == ["/x/y.PARQUET"]
    with pytest.raises(ValueError):
        M.resolve_paths(spark, "  ")
    base = work_dir(spark, "t")
    history(spark, [1]).write.parquet(f"{base}/other.parquet")
    with pytest.raises(FileNotFoundError):
        M.resolve_paths(spark, base)


def exports(spark):
    base = work_dir(spark, "exports")
    for stamp in ("1", "2"):
        retention.write_export(history(spark, [1]), base, stamp)
    history(spark, [1]).coalesce(1).write.parquet(f"{base}/plain")
    part = next(f for f in os.listdir(f"{base}/plain") if f.endswith(".parquet"))
    with open(f"{base}/plain/{part}", "rb") as source:
        content = source.read()
    for name in ("metrics_cold_3.parquet", "notes.txt", "metrics_cold_4.part"):
        with open(f"{base}/{name}", "wb") as sink:
            sink.write(content)
    return base


def test_manifest_newest_and_purge(spark):
    base = exports(spark)
    names = [r["name"] for r in M.list_exports(spark, base).collect()]
    assert names == ["metrics_cold_1.parquet", "metrics_cold_2.parquet", "metrics_cold_3.parquet"]
    assert M.newest_export(spark, base).first()["path"].endswith("metrics_cold_3.parquet")
    old = (dt.datetime(2024, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds()
    for folder in ("metrics_cold_1.parquet",):
        for f in os.listdir(f"{base}/{folder}"):
            os.utime(f"{base}/{folder}/{f}", (old, old))
    os.utime(f"{base}/notes.txt", (old, old))
    now = dt.datetime(2024, 3, 1)
    assert retention.purge(spark, base, now) == 1
    assert os.path.exists(f"{base}/metrics_cold_1.parquet")
    assert retention.purge(spark, base, now, dry_run=False) == 1
    left = os.listdir(base)
    assert "metrics_cold_1.parquet" not in left and {"metrics_cold_2.parquet", "metrics_cold_3.parquet", "notes.txt"} <= set(left)


def test_horizons():
    retention.check_horizons(30, 32)
    for bad in ((30, 30), (0, 5)):
        with pytest.raises(ValueError):
            retention.check_horizons(*bad)


def test_work_folders_go_at_once(spark):
    path = work_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    clear_work(spark)
    assert not os.path.exists(path)


def test_compaction_splits_without_loss(spark):
    base = work_dir(spark, "compact")
    export = retention.compact(history(spark, range(40)), NOW - dt.timedelta(days=30), f"{base}/cold", "20240101", f"{base}/hot")
    assert [r["path"] for r in M.list_exports(spark, f"{base}/cold").collect()] == M.resolve_paths(spark, f"{base}/cold")
    assert M.read_metrics(spark, export).columns == [f.name for f in M.METRICS_SCHEMA]
    cold, hot = spark.read.parquet(f"{base}/cold"), spark.read.parquet(f"{base}/hot")
    assert sorted(r["value"] for r in cold.collect()) == list(range(31, 40))
    assert sorted(r["value"] for r in hot.collect()) == list(range(31))
    assert cold.filter(F.col("dt") == F.to_date("ts")).count() == 9


def test_a_repeated_batch_replaces_itself(spark):
    base = work_dir(spark, "append")
    for _ in range(2):
        sinks.append_both(history(spark, [1, 2, 3]), f"{base}/h", f"{base}/r", 7)
    assert spark.read.parquet(f"{base}/h").count() == spark.read.parquet(f"{base}/r").count() == 3


def test_matrix_response(spark):
    rows = [('m{"a":"1"}', "m", '{"a":"1"}', t, v) for t, v in ((2_500_000, math.nan), (1_000_000, 1.5), (3_000_000, math.inf))]
    rows.append(("m{}", "m", "{}", 1_000_000, -0.0))
    points = spark.createDataFrame(rows, "series_key string, name string, labels string, ts_us bigint, value double")
    body = json.loads(sinks.response_json(points, clamped=True))
    assert body["status"] == "success" and body["data"]["resultType"] == "matrix" and len(body["warnings"]) == 1
    by_label = {e["metric"].get("a"): e for e in body["data"]["result"]}
    assert by_label["1"] == {"metric": {"__name__": "m", "a": "1"}, "values": [[1.0, "1.5"], [2.5, "NaN"], [3.0, "+Inf"]]}
    assert by_label[None]["values"] == [[1.0, "-0"]]
    assert "warnings" not in json.loads(sinks.response_json(points))


def test_exposition_mirror(spark):
    rows = [(0, NOW, "m", 1.0, '{"b":"x","a":"q\\"\\n"}'), (1, NOW, "m", 2.0, '{"a":"q\\"\\n","b":"x"}'), (2, NOW, "n", math.nan, "{}")]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, name string, value double, labels string")
    assert sorted(r["value"] for r in sinks.prom_text(df).collect()) == ['m{a="q\\"\\n",b="x"} 2', "n NaN"]


def test_grids(spark):
    rows = spark.createDataFrame([(NOW,), (NOW + dt.timedelta(hours=2),)], "ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    members = spark.createDataFrame([("DE",), ("US",), ("DE",)], "region string")
    assert grid.bucket_spine(rows, members).count() == 6
    expanded = grid.lateral_expand(spark.createDataFrame([(3,), (0,), (-1,), (None,)], "n bigint"), F.col("n"))
    assert [r["i"] for r in expanded.collect()] == [1, 2, 3]


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_only_a_measured_side_is_broadcast(spark, capsys):
    big = spark.range(1000).withColumn("k", F.col("id") % 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = small_side(spark.range(10).withColumnRenamed("id", "k"))
        assert "BroadcastHashJoin" in plan_of(big.join(small, "k"), capsys)
        large = broadcast_if(spark.range(10).withColumnRenamed("id", "k"), 10**9, 10)
        assert "BroadcastHashJoin" not in plan_of(big.join(large, "k"), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
