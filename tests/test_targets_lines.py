"""Conflicts settle in order without a job per clash; an answer is counted before it is made; every line has a kind."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import exposition as X, rangequery as R, targets as T
from gaugeline.session import shared_dir, file_system

TARGETS = "id string, name string, url string, ord int, origin string, allow array<string>"


def greedy(rows):
    names, urls, kept = set(), set(), []
    for row in sorted(rows, key=lambda r: (r[4] != "config", r[0])):
        name, url = (None if v is None else v.strip(" ") for v in row[1:3])
        if row[4] == "config" or (name not in names and url not in urls):
            kept.append(row[0])
            names.add(name)
            urls.add(url)
    return sorted(kept)


def chain(n):
    return [(f"t{i:03}", f"n{i // 2}", f"u{(i + 1) // 2}", 1, "dynamic", None) for i in range(n)]


@pytest.mark.parametrize("at_once", [T.AT_ONCE, 0])
def test_targets_settle_in_order(spark, at_once):
    rng = random.Random(3)
    mixed = [(f"t{i:03}", rng.choice([None, "", f"n{rng.randint(0, 30)}", f" n{rng.randint(0, 30)} "]), f"u{rng.randint(0, 40)}", 1, "dynamic", ["a"]) for i in range(60)]
    declared = [(f"cfg:{i}", f"n{i}", f"u{i}", 0, "config", None) for i in (1, 1, 2)]
    for rows in (mixed + declared, chain(12), [("x", "a", "1", 1, "dynamic", None), ("y", "a", "2", 1, "dynamic", None), ("z", "b", "2", 1, "dynamic", None)], declared, []):
        df = spark.createDataFrame(rows, TARGETS).repartition(3)
        found = T.resolve_conflicts(df, at_once)
        assert sorted(r["id"] for r in found.collect()) == greedy(rows) and found.columns == df.columns


def test_a_chain_takes_no_more_jobs_than_one_clash(spark):
    def jobs(rows):
        group = f"jobs-{len(rows)}-{random.random()}"
        spark.sparkContext.setJobGroup(group, "count")
        T.resolve_conflicts(spark.createDataFrame(rows, TARGETS)).collect()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return found

    assert jobs(chain(64)) <= jobs(chain(2)) + 1


def chains(number, n):
    return [(f"t{k}-{i:03}", f"n{k}-{i // 2}", f"u{k}-{(i + 1) // 2}", 1, "dynamic", None) for k in range(number) for i in range(n)]


def test_groups_settle_side_by_side_and_long_ones_in_blocks(spark):
    rows = chains(3, 16) + [(f"x{i:03}", f"x{i // 2}", f"v{(i + 1) // 2}", 1, "dynamic", None) for i in range(48)]
    df = spark.createDataFrame(rows, TARGETS).repartition(5)
    group = f"groups-{random.random()}"
    spark.sparkContext.setJobGroup(group, "count")
    found = T.resolve_conflicts(df, 32)
    assert sorted(r["id"] for r in found.collect()) == greedy(rows)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 150  # a round for every second row of the longest chain takes more


def files_below(spark):
    system, path = file_system(spark, shared_dir(spark))
    return system.getContentSummary(path).getFileCount()


def test_a_refused_answer_writes_nothing(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i), "m", float(i), '{"b":"1","a":"2"}' if i % 2 else '{"a":"2","b":"1"}') for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, name string, value double, labels string")
    q = R.range_args("m", start, start + dt.timedelta(seconds=399), 1, start + dt.timedelta(days=1))
    before = files_below(spark)
    with pytest.raises(R.TooManyPoints, match="400 points"):
        R.query_range(df, q, max_points=50)
    with pytest.raises(R.TooManyPoints):
        R.query_range_adaptive(df, q, max_points=50, retries=0)
    answer, used = R.query_range_adaptive(df, q, max_points=50, retries=3)
    assert files_below(spark) == before and used.step_us == 9_000_000 and answer.count() == 45
    assert sorted(map(tuple, answer.collect())) == sorted(map(tuple, R.query_range(df, used).collect()))


LINES = {
    "": ("blank", None), "  \t\r": ("blank", None), "# HELP x y": ("comment", None), " # TYPE c counter": ("comment", None), "c 1": ("sample", None), 'c{a="1",b="x}"} 2 17\r': ("sample", None),
    'c{a="1",} NaN': ("sample", None), "c{} +Inf": ("sample", None), 'c { a = "1" , b="2" } 3': ("sample", None), "c{garbage} 7": ("unread", "labels"), 'c{a="1" b="2"} 7': ("unread", "labels"),
    'c{a="1"': ("unread", "labels"), 'c{a="1" 7': ("unread", "labels"), 'b_bucket{le="1"} 5 # {trace_id="x"} 0.6 1': ("unread", "exemplar"), "c 5 # {} 1": ("unread", "exemplar"),
    "c abc": ("unread", "value"), 'c{a="1"} abc': ("unread", "value"), "c": ("unread", "line"), "not a sample line": ("unread", "line"), "9c 1": ("unread", "line"), "{} 1": ("unread", "line"),
}


def test_every_line_has_a_kind(spark):
    body = "\n".join(LINES)
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, body string")
    found = {r["id"]: r["kinds"] for r in df.select("id", X.line_kinds(F.col("body")).alias("kinds")).collect()}
    assert [(k["kind"], k["reason"]) for k in found[1]] == list(LINES.values()) and found[2] is None
    counts = {r["id"]: r["c"] for r in df.select("id", X.line_counts(X.line_kinds(F.col("body"))).alias("c")).collect()}
    c = counts[1]
    assert c["blank"] + c["comments"] + c["samples"] + c["unread"] == c["lines"] == len(LINES)
    assert sum(c[f"unread_{why}"] for why in ("exemplar", "labels", "value", "line")) == c["unread"] and counts[3]["lines"] == 1
    stored = X.parse_exposition(df).filter("id = 1")
    assert stored.count() == c["samples"] == 5


def test_long_lines_do_not_overflow(spark):
    long = ",".join(f'l{i}="{"x" * 50}\\""' for i in range(3000))
    df = spark.createDataFrame([("c{" + long + "} 1\nc{" + long + " 1\nc{" + "g" * 100_000 + "} 1",)], "body string")
    assert [k["kind"] for k in df.select(X.line_kinds(F.col("body")).alias("k")).first()["k"]] == ["sample", "unread", "unread"]
