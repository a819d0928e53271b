"""Files in and out, retention, and streams. Each run writes into a fresh folder of its own."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions import predicates as P
from gaugeline.functions.scalars import finite_or_null
from gaugeline.operators import ingest as I, sketches as K
from gaugeline.plans import cold
from gaugeline.session import checkpointed, work_dir
from gaugeline.sources import history as H, metrics as M, retention, sinks
from gaugeline.streaming import streams as S

from .base import Inputs, query, rounded

_CONFIG = I.IngestConfig(max_samples=8, max_body_bytes=2000)


def _exports(c: Inputs) -> str:
    """Three exports of the whole history: requests without the type column, durations, the rest."""
    base = work_dir(c.spark, "exports")
    m = c.metrics
    named = {"20240101": m.filter(P.named(cold.REQUESTS)).drop("metric_type"), "20240201": m.filter(P.named(cold.DURATION))}
    named["20240301"] = m.filter(~P.named_any([cold.REQUESTS, cold.DURATION])).withColumn("note", F.lit("extra"))
    for stamp, rows in named.items():
        rows.write.option("compression", "zstd").parquet(f"{base}/metrics_cold_{stamp}.parquet")
    m.limit(0).write.parquet(f"{base}/notes")
    return base


@query("scan_metrics_union", """SELECT ts, name, value, CASE WHEN name = 'http_requests_total' THEN NULL ELSE metric_type END AS metric_type, labels,
  CASE WHEN name IN ('visitors_total', 'unique_visitors_estimate') THEN 'extra' END AS note FROM metrics_all""")
def _(c: Inputs):
    return M.read_metrics(c.spark, M.resolve_paths(c.spark, _exports(c)), extra=True)


@query("resolve_source", "SELECT name, count(*) AS n FROM metrics_all GROUP BY 1")
def _(c: Inputs):
    rows = M.read_metrics(c.spark, M.resolve_paths(c.spark, f" {_exports(c)}/ "))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _with_rows(c: Inputs, exports: DataFrame) -> DataFrame:
    """The listed exports and how many rows each holds."""
    paths = [row["path"] for row in exports.select("path").collect()]
    rows = M.read_metrics(c.spark, paths).select(F.regexp_extract("_metadata.file_path", "/(metrics_cold_[^/]*)/", 1).alias("name"))
    return exports.select("name").join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name")


_MANIFEST = """SELECT CASE name WHEN 'http_requests_total' THEN 'metrics_cold_20240101.parquet'
  WHEN 'http_request_duration_ms' THEN 'metrics_cold_20240201.parquet' ELSE 'metrics_cold_20240301.parquet' END AS name, count(*) AS n
FROM metrics_all GROUP BY 1"""


@query("cold_manifest", _MANIFEST)
def _(c: Inputs):
    return _with_rows(c, M.list_exports(c.spark, _exports(c)))


@query("newest_export", f"SELECT * FROM ({_MANIFEST}) ORDER BY name DESC LIMIT 1")
def _(c: Inputs):
    newest = M.newest_export(c.spark, _exports(c)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return _with_rows(c, newest)


@query("expired_exports", _MANIFEST)
def _(c: Inputs):
    later = dt.datetime.fromtimestamp(time.time(), dt.timezone.utc).replace(tzinfo=None, microsecond=0) + dt.timedelta(days=33)
    return _with_rows(c, retention.expired_exports(c.spark, _exports(c), later))


@query("unexpired_rows", "SELECT name, ts, value FROM metrics_all WHERE ts >= (SELECT t FROM as_of) - INTERVAL 20 DAY")
def _(c: Inputs):
    return retention.unexpired_rows(c.metrics, c.as_of, 20).select("name", "ts", "value")


@query("compact_to_cold", """SELECT CASE WHEN ts < (SELECT t FROM as_of) - INTERVAL 10 DAY THEN 'cold' ELSE 'hot' END AS part, name, ts, labels, metric_type
FROM metrics_all""")
def _(c: Inputs):
    base = work_dir(c.spark, "compact")
    export = retention.compact(c.metrics, c.as_of - dt.timedelta(days=10), base, "20240131", f"{base}/hot")
    columns = ["name", "ts", "labels", "metric_type"]
    old = M.read_metrics(c.spark, export).select(F.lit("cold").alias("part"), *columns)
    return old.unionByName(c.spark.read.parquet(f"{base}/hot").select(F.lit("hot").alias("part"), *columns))


@query("cold_loop", """SELECT 'metrics_cold_20240131.parquet' AS name, count(*) AS n, sum(CASE WHEN name = 'http_requests_total' THEN 1 ELSE 0 END)::BIGINT AS requests,
  2 AS expired, 1 AS newest, 0 AS purged FROM metrics_all WHERE ts < (SELECT t FROM as_of) - INTERVAL 10 DAY""")
def _(c: Inputs):
    """History that was compacted is listed, resolved, read back, found expired and counted for purging."""
    base = work_dir(c.spark, "loop")
    retention.compact(c.metrics, c.as_of - dt.timedelta(days=10), base, "20240131", f"{base}/hot")
    retention.write_export(c.metrics.limit(0), base, "20230101")
    later = dt.datetime.fromtimestamp(time.time(), dt.timezone.utc).replace(tzinfo=None, microsecond=0) + dt.timedelta(days=33)
    rows = M.read_metrics(c.spark, M.resolve_paths(c.spark, base))
    newest = M.newest_export(c.spark, base).select(F.col("path").endswith("20240131.parquet").cast("int").alias("newest"))
    now = later - dt.timedelta(days=33)
    counted = rows.groupBy(F.regexp_extract("_metadata.file_path", "/(metrics_cold_[^/]*)/", 1).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") == cold.REQUESTS).alias("requests"))
    expired = retention.purge(c.spark, base, later)
    purged = retention.purge(c.spark, base, now, dry_run=False)
    return counted.select("*", F.lit(expired).alias("expired"), newest.scalar().alias("newest"), F.lit(purged).alias("purged"))


_DAY = "date_trunc('day', (SELECT t FROM as_of)) - INTERVAL 15 DAY"


def _compacted(c: Inputs, label: str) -> str:
    base = work_dir(c.spark, label)
    retention.compact(c.metrics, c.as_of - dt.timedelta(days=10), base, "20240131", f"{base}/hot")
    return base


@query("history_one_day", f"""SELECT ts, name, value, labels FROM metrics_all
WHERE ts >= {_DAY} AND ts <= {_DAY} + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND""")
def _(c: Inputs):
    """One day of compacted history: the files of its folder are opened and no others."""
    day = c.as_of.replace(hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=15)
    last = day + dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    return H.read_history(c.spark, _compacted(c, "day"), day, last).select("ts", "name", "value", "labels")


@query("history_hours_of_metric", f"""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS total FROM metrics_all
WHERE name = 'http_requests_total' AND ts BETWEEN {_DAY} AND {_DAY} + INTERVAL 3 DAY GROUP BY 1""")
def _(c: Inputs):
    """Three days of one metric, over an export with day folders and one without."""
    base = _compacted(c, "hours")
    first = c.as_of.replace(hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=15)
    retention.write_export(c.metrics.filter(~F.col("ts").between(F.lit(first - dt.timedelta(days=400)), F.lit(first + dt.timedelta(days=400)))), base, "20240201")
    rows = H.read_history(c.spark, base, first, first + dt.timedelta(days=3), [cold.REQUESTS])
    return rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("compact_and_switch", """SELECT step, part, count(*) AS n FROM (
  SELECT unnest(['begun', 'died']) AS step, 'recent' AS part FROM metrics_all
  UNION ALL SELECT 'switched', CASE WHEN ts < (SELECT t FROM as_of) - INTERVAL 10 DAY THEN 'history' ELSE 'recent' END FROM metrics_all
  UNION ALL SELECT 'again', CASE WHEN ts < (SELECT t FROM as_of) - INTERVAL 5 DAY THEN 'history' ELSE 'recent' END FROM metrics_all
  UNION ALL SELECT 'back', 'recent' FROM metrics_all) GROUP BY ALL""")
def _(c: Inputs):
    """Readers see every row once: before a compaction, after one that died between its two tables, after two that did not, and rolled back."""
    root = work_dir(c.spark, "switch")
    c.metrics.write.parquet(f"{root}/recent-0")
    first = H.commit(c.spark, root, f"{root}/recent-0", [], -1)
    seen = []

    def look(step: str) -> None:
        recent, history = H.read_committed(c.spark, root)
        for part, rows in (("recent", recent), ("history", history)):
            if rows is not None:
                seen.append(checkpointed(rows.groupBy(F.lit(step).alias("step"), F.lit(part).alias("part")).agg(F.count(F.lit(1)).alias("n"))))

    look("begun")
    old, _ = retention.split_by_age(c.metrics, c.as_of - dt.timedelta(days=12))
    retention.write_export(old, root, "20240131")  # all that a run left that died before its recent table
    look("died")
    retention.compact_and_switch(c.spark, root, c.as_of - dt.timedelta(days=10), "20240131")
    look("switched")
    retention.compact_and_switch(c.spark, root, c.as_of - dt.timedelta(days=5), "20240205")
    look("again")
    H.roll_back(c.spark, root, first)
    look("back")
    return M.union_by_name(seen)


@query("hot_append", """SELECT 'history' AS side, name, count(*) AS n FROM hot_samples GROUP BY 2
UNION ALL SELECT 'recent', name, count(*) FROM hot_samples GROUP BY 2""")
def _(c: Inputs):
    base = work_dir(c.spark, "append")
    for batch in (0, 1, 1):
        sinks.append_both(c.hot.filter(F.col("seq") % 2 == batch), f"{base}/history", f"{base}/recent", batch)
    sides = [
        c.spark.read.parquet(f"{base}/{side}").groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "name", "n")
        for side in ("history", "recent")
    ]
    return sides[0].unionByName(sides[1])


# Streams. The input is landed in three parts by arrival, each of as many files as there are cores here, and read one part per batch.

FILES = 8


def _landed(
    c: Inputs, rows: DataFrame, label: str, replay: bool = False, part_of: Column | None = None, spread: bool = False
) -> tuple[str, str]:
    """Land the rows; those that are ``spread`` over as many parts as there shall be files do not move again."""
    base = work_dir(c.spark, label)
    top = rows.agg(F.max("seq")).first()[0] + 1 if part_of is None else 0
    for part in range(3):
        piece = rows.filter((F.col("seq") >= top * part // 3) & (F.col("seq") < top * (part + 1) // 3) if part_of is None else part_of == part)
        for copy in range(2 if replay else 1):
            (piece if spread else piece.repartition(FILES)).write.parquet(f"{base}/in/p{part}{copy}")
    return base, f"{base}/in/*"


def _stream(c: Inputs, path: str, like: DataFrame, files: int = FILES) -> DataFrame:
    return S.read_files(c.spark, path, like, files)


@query("stream_ingest", """SELECT l.scrape_id, l.target, l.name, l.value, l.labels, l.line_no
FROM accepted_lines l JOIN payload_status s USING (scrape_id) WHERE s.fetch_reason IS NULL AND rank <= 8""")
def _(c: Inputs):
    files = max(FILES, c.spark.sparkContext.defaultParallelism)  # a batch keeps all cores busy
    payloads = c.spread_payloads(files)
    base, path = _landed(c, payloads, "ingest", spread=True)
    source = _stream(c, path, payloads, files)
    S.stream_ingest(source, c.targets(), f"{base}/out", f"{base}/checkpoint", _CONFIG).awaitTermination()
    return c.spark.read.parquet(f"{base}/out/samples").select("scrape_id", "target", "name", "value", "labels", "line_no")


@query("stream_throughput", """SELECT epoch_us(date_trunc('day', ts)) AS bucket_us, count(*) FILTER (WHERE name = 'http_requests_total') AS reqs,
  round(avg(value) FILTER (WHERE name = 'http_request_duration_ms'), 6) AS avg_ms FROM metrics_all
GROUP BY 1 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def _(c: Inputs):
    m = c.metrics.withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")))
    first = m.agg(F.min("seq")).first()[0]
    m = m.withColumn("seq", F.col("seq") - first)
    base, path = _landed(c, m, "throughput")
    S.stream_throughput(_stream(c, path, m), f"{base}/out", f"{base}/checkpoint", "1 day", "1 hour").awaitTermination()
    return rounded(c.spark.read.parquet(f"{base}/out"), "avg_ms")


@query("stream_counter_diff", """SELECT series_key, ts_us, greatest(0, v - pv) AS diff FROM (
  SELECT concat(name, labels) AS series_key, epoch_us(ts) AS ts_us, v, lag(v) OVER (PARTITION BY name, labels ORDER BY ts, seq) AS pv
  FROM (SELECT *, CASE WHEN isfinite(value) THEN value END AS v FROM hot_samples))
WHERE v IS NOT NULL AND pv IS NOT NULL""")
def _(c: Inputs):
    base, path = _landed(c, c.keyed, "diffs")
    S.stream_counter_diffs(_stream(c, path, c.keyed), f"{base}/out", f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{base}/out/diffs").select("series_key", "ts_us", "diff")


_HOLD_US = 6 * 3_600_000_000


@query("stream_counter_diff_shuffled", """SELECT series_key, ts_us, greatest(0, v - pv) AS diff FROM (
  SELECT concat(name, labels) AS series_key, epoch_us(ts) AS ts_us, v, lag(v) OVER (PARTITION BY name, labels ORDER BY ts, seq) AS pv
  FROM (SELECT *, CASE WHEN isfinite(value) THEN value END AS v FROM hot_samples))
WHERE v IS NOT NULL AND pv IS NOT NULL""")
def _(c: Inputs):
    """Samples that arrive up to six hours out of order give the differences of those in order."""
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("seq"), F.lit(_HOLD_US))
    low, high = c.keyed.agg(F.min(arrival), F.max(arrival)).first()
    part = F.least(F.floor((arrival - low) * 3 / (high - low)), F.lit(2))
    base, path = _landed(c, c.keyed, "shuffled", part_of=part)
    S.stream_counter_diffs(_stream(c, path, c.keyed), f"{base}/out", f"{base}/state", f"{base}/checkpoint", delay_us=_HOLD_US).awaitTermination()
    S.finish_counter_diffs(c.keyed, f"{base}/out", f"{base}/state")
    return c.spark.read.parquet(f"{base}/out/diffs").select("series_key", "ts_us", "diff")


@query("stream_split", """WITH parts AS (SELECT ts, minute(ts) % 3 AS part FROM metrics_all),
tops AS (SELECT p.part, max(q.ts) AS top FROM (SELECT DISTINCT part FROM parts) p LEFT JOIN parts q ON q.part < p.part GROUP BY 1)
SELECT date_trunc('day', ts) AS day, CASE WHEN date_trunc('day', ts) + INTERVAL 1 DAY <= top - INTERVAL 1 HOUR THEN 'late' ELSE 'ontime' END AS place, count(*) AS n
FROM parts JOIN tops USING (part) GROUP BY 1, 2""")
def _(c: Inputs):
    """Rows whose day was closed when they came are set aside; all others are in time."""
    base, path = _landed(c, c.metrics, "split", part_of=F.minute("ts") % 3)
    S.stream_split(_stream(c, path, c.metrics), f"{base}/out", f"{base}/checkpoint", width_us=86_400_000_000).awaitTermination()
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    places = [
        c.spark.read.parquet(f"{base}/out/{place}").groupBy(day).agg(F.count(F.lit(1)).alias("n")).select("day", F.lit(place).alias("place"), "n")
        for place in ("ontime", "late")
    ]
    return places[0].unionByName(places[1])


@query("stream_append", """SELECT 'history' AS side, name, count(*) AS n FROM hot_samples GROUP BY 2
UNION ALL SELECT 'recent', name, count(*) FROM hot_samples GROUP BY 2""")
def _(c: Inputs):
    """One stream into history and the recent table; its second batch comes twice."""
    base, path = _landed(c, c.hot, "both")
    sides = [f"{base}/history", f"{base}/recent"]
    S.stream_append(_stream(c, path, c.hot), *sides, f"{base}/checkpoint").awaitTermination()
    again = checkpointed(c.spark.read.parquet(f"{sides[0]}/batch=1"))
    S.append_batch(*sides)(again, 1)
    counts = [c.spark.read.parquet(side).groupBy("name").agg(F.count(F.lit(1)).alias("n")) for side in sides]
    return M.union_by_name([n.select(F.lit(side).alias("side"), "name", "n") for n, side in zip(counts, ("history", "recent"), strict=True)])


@query("sketch_day_p99", """SELECT date_trunc('day', ts) AS day, count(*) AS n, true AS within FROM metrics_all
WHERE name = 'http_request_duration_ms' AND isfinite(value) GROUP BY 1""")
def _(c: Inputs):
    """The 99th percentile of each day from stored sketches of its hours; whether its rank lies within the error of a sketch."""
    base = work_dir(c.spark, "sketches")
    rows = c.metrics.filter(P.named(cold.DURATION)).select("ts", "value")
    K.sketch_buckets(rows, [F.date_trunc("hour", "ts").alias("hour")]).write.parquet(base)
    days = K.widen(c.spark.read.parquet(base), [F.date_trunc("day", "hour").alias("day")]).select("day", "n", K.quantile_of("sketch", 0.99).alias("p99"))
    ranked = rows.join(F.broadcast(days), F.date_trunc("day", "ts") == F.col("day")).groupBy("day", "n").agg(  # a row for each day
        F.count_if(F.col("value") < F.col("p99")).alias("below"), F.count_if(F.col("value") <= F.col("p99")).alias("upto"))
    error = F.lit(2 * K.rank_error()) * F.col("n") + 1
    within = (F.col("below") <= F.col("n") * 0.99 + error) & (F.col("upto") >= F.col("n") * 0.99 - error)
    return ranked.select(F.col("day").cast("timestamp_ntz").alias("day"), "n", within.alias("within"))


@query("stream_status_places", """WITH log AS (
  SELECT target, attempt_seq % 3 AS part, CASE WHEN attempt_seq % 11 <> 5 THEN attempt_seq END AS n FROM scrape_outcomes),
tops AS (SELECT DISTINCT l.target, p.part, (SELECT max(n) FROM log e WHERE e.target = l.target AND e.part < p.part) AS top FROM log l, (VALUES (0), (1), (2)) p(part))
SELECT target, count(*) FILTER (WHERE n IS NOT NULL AND (top IS NULL OR n > top)) AS used,
  count(*) FILTER (WHERE n <= top) AS late, count(*) FILTER (WHERE n IS NULL) AS unordered, count(*) FILTER (WHERE n IS NULL OR n <= top) AS left_out
FROM log JOIN tops USING (target, part) GROUP BY 1""")
def _(c: Inputs):
    """A log out of order and partly without numbers: each attempt is counted, late or unordered, and what is not counted is kept."""
    rows = c.view("scrape_outcomes").withColumn("part", F.col("attempt_seq") % 3)
    rows = rows.withColumn("attempt_seq", F.when(F.col("attempt_seq") % 11 != 5, F.col("attempt_seq")))
    base, path = _landed(c, rows, "places", part_of=F.col("part"))
    S.stream_target_status(_stream(c, path, rows), f"{base}/state", f"{base}/checkpoint", f"{base}/aside").awaitTermination()
    aside = c.spark.read.parquet(f"{base}/aside").groupBy("target").agg(
        F.count_if(F.col("reason") == "late").alias("_late"), F.count_if(F.col("reason") == "unordered").alias("_unordered"))
    state = S.current_state(c.spark, f"{base}/state").join(aside, "target", "left")
    used = F.col("ok") + F.col("fetch_error") + F.col("parse_error") + F.col("other")
    none = F.lit(0)
    return state.select("target", used.alias("used"), F.coalesce("_late", none).alias("late"), F.coalesce("_unordered", none).alias("unordered"), F.col("late").alias("left_out"))


@query("stream_recent_keep", "SELECT seq, ts, name, value FROM hot_samples ORDER BY seq DESC LIMIT 2000")
def _(c: Inputs):
    base, path = _landed(c, c.hot, "recent")
    S.stream_recent(_stream(c, path, c.hot), f"{base}/state", f"{base}/checkpoint", 2000).awaitTermination()
    return S.current_state(c.spark, f"{base}/state").select("seq", "ts", "name", "value")


@query("stream_target_status", """SELECT target, last_status, last_ts, last_samples, last_duration_ms, consecutive_failures, ok, fetch_error, parse_error
FROM (SELECT o.target, arg_max(status, attempt_seq) AS last_status, arg_max(ts, attempt_seq) AS last_ts,
    arg_max(samples, attempt_seq) AS last_samples, arg_max(duration_ms, attempt_seq) AS last_duration_ms,
    count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'fetch_error') AS fetch_error,
    count(*) FILTER (WHERE status = 'parse_error') AS parse_error,
    count(*) FILTER (WHERE attempt_seq > coalesce(k.last_ok, -1)) AS consecutive_failures
  FROM scrape_outcomes o LEFT JOIN (
    SELECT target, max(attempt_seq) AS last_ok FROM scrape_outcomes WHERE status = 'ok' GROUP BY 1) k USING (target) GROUP BY 1)""")
def _(c: Inputs):
    rows = c.view("scrape_outcomes").withColumn("seq", F.col("attempt_seq"))
    base, path = _landed(c, rows, "status")
    S.stream_target_status(_stream(c, path, rows), f"{base}/state", f"{base}/checkpoint").awaitTermination()
    columns = ("target", "last_status", "last_ts", "last_samples", "last_duration_ms", "consecutive_failures", "ok", "fetch_error", "parse_error")
    return S.current_state(c.spark, f"{base}/state").select(*columns)


@query("stream_latest_series", """SELECT concat(name, labels) AS series_key, CASE WHEN isfinite(value) THEN value END AS value, ts_us FROM (
  SELECT name, labels, arg_max(value, seq) AS value, max(epoch_us(ts)) AS ts_us FROM hot_samples GROUP BY 1, 2)""")
def _(c: Inputs):
    base, path = _landed(c, c.keyed, "latest")
    S.stream_latest_series(_stream(c, path, c.keyed), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return S.latest_series(c.spark, f"{base}/out").withColumn("value", finite_or_null("value"))


@query("stream_dedupe_payloads", "SELECT scrape_id, target FROM scrape_payloads")
def _(c: Inputs):
    base, path = _landed(c, c.payloads, "dedupe", replay=True)
    unique = S.dedupe_payloads(_stream(c, path, c.payloads), "20 days")
    S.write_stream(unique, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{base}/out").select("scrape_id", "target")
