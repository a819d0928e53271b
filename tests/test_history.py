"""Compacted history is read by the day and by the file; the switch to a new recent table is one step."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import predicates as P
from gaugeline.plans import cold
from gaugeline.session import work_dir
from gaugeline.sources import history as H, metrics as M, retention

NOW = dt.datetime(2024, 3, 10)
ROWS = "ts timestamp_ntz, name string, value double, metric_type string, labels string"


@pytest.fixture(scope="module")
def export(spark):
    """Twenty days of two metrics, one row an hour each, compacted."""
    base = work_dir(spark, "history")
    hours = spark.range(24 * 20).select(F.expr("timestamp_ntz'2024-02-15 00:00:00' + make_dt_interval(0, cast(id as int))").alias("ts"), "id")
    rows = hours.crossJoin(spark.createDataFrame([("a_total",), ("b_total",)], "name string"))
    rows = rows.select("ts", "name", F.col("id").cast("double").alias("value"), F.lit("counter").alias("metric_type"), F.lit("{}").alias("labels"))
    retention.compact(rows, NOW, base, "20240310", f"{base}/recent-0")
    return base


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_hour_prunes_by_day_and_opens_the_files_of_that_day(spark, export):
    start = dt.datetime(2024, 2, 20, 7)
    table = M.read_metrics(spark, M.resolve_paths(spark, export), days=True)
    assert table.schema["dt"].dataType.simpleString() == "date"
    hour = table.filter(P.between_closed(table, start, start + dt.timedelta(hours=1)))
    plan = scans(hour)
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert hour.count() == 4
    picked = H.read_history(spark, export, start, start + dt.timedelta(hours=1))
    assert picked.count() == 4 and picked.inputFiles() and all("dt=2024-02-20" in f for f in picked.inputFiles())
    one = H.read_history(spark, export, start, start + dt.timedelta(hours=1), ["a_total"])
    assert one.count() == 2 and len(one.inputFiles()) <= len(picked.inputFiles())
    as_folders = H.read_history(spark, export, start, start + dt.timedelta(hours=1), max_picked=0)
    assert as_folders.count() == 4 and len(as_folders.inputFiles()) > len(picked.inputFiles())


def test_reports_on_compacted_history_prune(spark, export):
    table = M.read_metrics(spark, M.resolve_paths(spark, export), days=True)
    assert "PartitionFilters: [isnotnull(dt" in scans(table.filter(P.in_range(table, "24h", dt.datetime(2024, 3, 1))))
    plain = table.drop("dt")
    for key in ("24h", "all"):
        rows = [sorted(map(tuple, cold.throughput_latency(t, key, dt.datetime(2024, 3, 1)).collect())) for t in (table, plain)]
        assert rows[0] == rows[1]


def test_nothing_in_range_and_exports_without_days(spark, export):
    assert H.read_history(spark, export, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)).count() == 0
    assert H.read_history(spark, export, names=["c_total"]).count() == 0
    rows = [(dt.datetime(2024, 2, 20, 7, 30), "a_total", 1.0, "counter", "{}"), (None, "a_total", 2.0, "counter", "{}")]
    base = work_dir(spark, "plain")
    retention.write_export(spark.createDataFrame(rows, ROWS), base, "20240101")
    both = M.resolve_paths(spark, base) + M.resolve_paths(spark, export)
    found = H.read_history(spark, both, dt.datetime(2024, 2, 20), dt.datetime(2024, 2, 21), ["a_total"])
    assert found.count() == 26 and H.read_history(spark, both).count() == 24 * 20 * 2 + 2
    wide = M.read_metrics(spark, both, extra=True, days=True)
    assert wide.count() == 24 * 20 * 2 + 2 and wide.schema["dt"].dataType.simpleString() == "date"


def test_rows_without_a_time_stay_recent(spark):
    rows = spark.createDataFrame([(None, "a", 1.0, "counter", "{}"), (dt.datetime(2024, 1, 1), "a", 1.0, "counter", "{}")], ROWS)
    old, young = retention.split_by_age(rows, NOW)
    assert (old.count(), young.count()) == (1, 1)


def test_a_run_that_died_leaves_every_row_readable_once(spark):
    root = work_dir(spark, "switch")
    rows = spark.createDataFrame([(NOW - dt.timedelta(days=d), "a", float(d), "counter", "{}") for d in range(20)], ROWS)
    rows.write.parquet(f"{root}/recent-0")
    with pytest.raises(FileNotFoundError):
        H.current(spark, root)
    H.commit(spark, root, f"{root}/recent-0", [], -1)

    def seen():
        recent, history = H.read_committed(spark, root)
        values = [r["value"] for r in recent.collect()] + ([r["value"] for r in history.collect()] if history is not None else [])
        return sorted(values)

    every = [float(d) for d in range(20)]
    cutoff = NOW - dt.timedelta(days=10)
    retention.compact(rows.filter("value > 15"), cutoff, root, "20240310", f"{root}/elsewhere")  # died before the commit
    assert seen() == every
    assert retention.compact_and_switch(spark, root, cutoff, "20240310") == 1
    recent, history = H.read_committed(spark, root)
    assert seen() == every and (recent.count(), history.count()) == (11, 9)
    with pytest.raises(FileExistsError):
        H.commit(spark, root, "x", [], 0)
    with pytest.raises(FileExistsError):
        retention.compact_and_switch(spark, root, cutoff, "20240310")
    assert H.roll_back(spark, root, 0) == 2 and seen() == every and H.read_committed(spark, root)[1] is None


def test_purging_takes_the_ranges_along(spark, export):
    base = work_dir(spark, "purge")
    rows = spark.createDataFrame([(NOW - dt.timedelta(days=3), "a", 1.0, "counter", "{}")], ROWS)
    path = retention.compact(rows, NOW, base, "20240310", f"{base}/hot")
    assert H.file_ranges(spark, [path])[1] == []
    assert retention.purge(spark, base, dt.datetime(2124, 1, 1), dry_run=False) == 1
    assert H.file_ranges(spark, [path]) == (None, [path])
