"""Range queries and reports over the recent window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gaugeline.functions import predicates as P
from gaugeline.functions.labels import label, series_key
from gaugeline.functions.scalars import epoch_micros, micros
from gaugeline.operators import rangequery as R, ring
from gaugeline.operators.series import counter_diffs, first_last_delta
from gaugeline.plans import hot
from gaugeline.sources import sinks
from gaugeline.sources.metrics import union_by_name

from .base import Inputs, query, rounded

# The literal range query of the keys below: two days before as_of, 15-minute steps.
_RANGE = "SELECT epoch_us(t) - 172800000000 AS start_us, epoch_us(t) AS end_us, 900000000 AS step_us FROM as_of"


def _bucketed(name_filter: str, extra: str = "") -> str:
    return f"""SELECT concat(name, labels) AS series_key, bucket, ts_us, value FROM (
  SELECT h.name, h.labels, (epoch_us(h.ts) - r.start_us) // r.step_us AS bucket, epoch_us(h.ts) AS ts_us, h.value,
    row_number() OVER (PARTITION BY h.name, h.labels, (epoch_us(h.ts) - r.start_us) // r.step_us ORDER BY h.ts DESC, h.seq DESC) AS rn
  FROM hot_samples h, ({_RANGE}) r WHERE {name_filter} AND epoch_us(h.ts) BETWEEN r.start_us AND r.end_us {extra}) WHERE rn = 1"""


def _args(c: Inputs, name: str, step="15m", matchers=None) -> R.RangeQuery:
    now = c.as_of
    return R.range_args(name, now - dt.timedelta(days=2), now, step, now, matchers)


def _points(c: Inputs):
    return hot.dashboard_points(c.hot, hot.plan_window(c.hot, "7d", c.as_of))


@query("query_range", _bucketed("h.name = 'http_requests_total'",
       "AND json_extract_string(h.labels, '$.scrape_target') = 'app4' AND json_extract_string(h.labels, '$.status') = '200'"))
def _(c: Inputs):
    q = _args(c, "http_requests_total", "15m", {"scrape_target": "app4", "status": "200"})
    return R.query_range(c.hot, q).select("series_key", "bucket", "ts_us", "value")


@query("query_range_keyed", _bucketed("h.name = 'visitors_total'"))
def _(c: Inputs):
    return R.query_range(c.keyed, _args(c, "visitors_total", 900)).select("series_key", "bucket", "ts_us", "value")


@query("query_range_missing", "SELECT count(*) AS n FROM hot_samples WHERE name = 'no_such_metric'")
def _(c: Inputs):
    return R.query_range(c.hot, _args(c, "no_such_metric")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_per_bucket", _bucketed("true"))
def _(c: Inputs):
    q = _args(c, "any")
    return R.latest_per_bucket(R.within(c.hot, q.start_us, q.end_us), q.start_us, q.step_us).select("series_key", "bucket", "ts_us", "value")


@query("series_group", "SELECT concat(name, labels) AS series_key, count(*) AS n FROM hot_samples GROUP BY 1")
def _(c: Inputs):
    return c.hot.groupBy(series_key(c.hot).alias("series_key")).agg(F.count(F.lit(1)).alias("n"))


@query("step_bucket", f"""SELECT h.seq, (epoch_us(h.ts) - r.start_us) // r.step_us AS bucket FROM hot_samples h, ({_RANGE}) r
WHERE epoch_us(h.ts) BETWEEN r.start_us AND r.end_us""")
def _(c: Inputs):
    q = _args(c, "any")
    return R.within(c.hot, q.start_us, q.end_us).select("seq", R.step_bucket(micros("ts"), q.start_us, q.step_us).alias("bucket"))


@query("range_args", """SELECT epoch_us(t) - 86400000000 AS start_us, epoch_us(t) AS end_us, CAST(90000000 AS BIGINT) AS step_us,
  count(*) AS n FROM hot_samples, as_of WHERE name = 'visitors_total'
  AND epoch_us(ts) BETWEEN epoch_us(t) - 86400000000 AND epoch_us(t) GROUP BY 1, 2, 3""")
def _(c: Inputs):
    now = c.as_of
    q = R.range_args("visitors_total", epoch_micros(now) / 1e6 - 86400, str(epoch_micros(now) / 1e6 + 500), "1.5m", now)
    hits = R.within(c.hot.filter(P.named(q.name)), q.start_us, q.end_us)
    bounds = [F.lit(v).cast("bigint").alias(n) for n, v in (("start_us", q.start_us), ("end_us", q.end_us), ("step_us", q.step_us))]
    return hits.groupBy(*bounds).agg(F.count(F.lit(1)).alias("n"))


@query("point_cap", f"SELECT count(*) > 100 AS refused, CASE WHEN count(*) > 100 THEN count(*) END AS points FROM ({_bucketed('true')}) "
       "WHERE series_key LIKE 'http_requests_total%'")
def _(c: Inputs):
    try:
        R.query_range(c.hot, _args(c, "http_requests_total"), max_points=100)
        refused, points = False, None
    except R.TooManyPoints as over:
        refused, points = True, over.points
    n = F.count(F.lit(1))
    counted = R.query_range(c.hot, _args(c, "http_requests_total")).agg(n.alias("all"))
    told = F.lit(points).cast("bigint")
    return counted.select((F.lit(refused) & (F.col("all") > 100)).alias("refused"), F.when(F.col("all") == told, told).alias("points"))


@query("coverage_warning", "SELECT (SELECT epoch_us(arg_min(ts, seq)) FROM hot_samples) > epoch_us(t) - 3456000000000 AS clamped FROM as_of")
def _(c: Inputs):
    return R.coverage_warning(c.hot, epoch_micros(c.as_of) - 40 * 86_400_000_000)


# The step is widened while the answer is too large: what each attempt counts decides the next one.
_ADAPTIVE = f"""SELECT series_key, bucket, ts_us, value, step_us FROM (
  SELECT concat(h.name, h.labels) AS series_key, (epoch_us(h.ts) - r.start_us) // t.step_us AS bucket, epoch_us(h.ts) AS ts_us, h.value, t.step_us,
    row_number() OVER (PARTITION BY h.name, h.labels, (epoch_us(h.ts) - r.start_us) // t.step_us ORDER BY h.ts DESC, h.seq DESC) AS rn
  FROM hot_samples h, ({_RANGE}) r, (
    WITH RECURSIVE held AS (
      SELECT concat(name, labels) AS k, epoch_us(ts) - start_us AS d FROM hot_samples, ({_RANGE})
      WHERE name = 'http_requests_total' AND epoch_us(ts) BETWEEN start_us AND end_us),
    tries(step, attempt, n) AS (
      SELECT CAST(60 AS BIGINT), 0, (SELECT count(*) FROM (SELECT DISTINCT k, d // 60000000 FROM held))
      UNION ALL SELECT wider, attempt + 1, (SELECT count(*) FROM (SELECT DISTINCT k, d // (wider * 1000000) FROM held)) FROM (
        SELECT greatest(step + 1, CAST(ceil(step * n * CAST(1.05 AS DOUBLE) / 1500) AS BIGINT)) AS wider, attempt FROM tries WHERE n > 1500 AND attempt < 8))
    SELECT step * 1000000 AS step_us FROM tries WHERE n <= 1500) t
  WHERE h.name = 'http_requests_total' AND epoch_us(h.ts) BETWEEN r.start_us AND r.end_us) WHERE rn = 1"""


@query("query_range_adaptive", _ADAPTIVE)
def _(c: Inputs):
    points, used = R.query_range_adaptive(c.hot, _args(c, "http_requests_total", 60), max_points=1500, retries=8)
    return points.select("series_key", "bucket", "ts_us", "value", F.lit(used.step_us).alias("step_us"))


@query("plan_window", "SELECT start_us, end_us, step, end_us - start_us AS covered_us FROM hot_plan")
def _(c: Inputs):
    return hot.plan_table(c.hot, "7d", c.as_of)


@query("metric_names_recent", "SELECT DISTINCT name FROM hot_samples ORDER BY 1")
def _(c: Inputs):
    return ring.metric_names(c.hot)


@query("buffer_span", """SELECT epoch_us(arg_min(ts, seq)) AS oldest_us, epoch_us(arg_max(ts, seq)) AS newest_us,
  epoch_us(arg_min(ts, seq)) // 1000000 AS oldest_s, epoch_us(arg_max(ts, seq)) // 1000000 AS newest_s FROM hot_samples""")
def _(c: Inputs):
    return ring.buffer_span(c.hot)


@query("buffer_occupancy", "SELECT count(*) AS samples, CAST(20000 AS BIGINT) AS capacity FROM hot_samples")
def _(c: Inputs):
    return ring.buffer_occupancy(c.hot)


@query("recent_keep_newest", "SELECT seq, ts, name, value FROM hot_samples ORDER BY seq DESC LIMIT 20000")
def _(c: Inputs):
    return ring.keep_newest(c.hot).select("seq", "ts", "name", "value")


@query("keep_newest_n", "SELECT o_orderkey AS seq, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 500")
def _(c: Inputs):
    return ring.keep_newest(c.table("orders").select(F.col("o_orderkey").alias("seq"), "o_totalprice"), 500)


@query("eviction_counts", """SELECT target, 'over_cap' AS reason, CAST(sum(greatest(s - 5000, 0) - greatest(s - n - 5000, 0)) AS BIGINT) AS dropped FROM (
  SELECT target, n, sum(n) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT json_extract_string(labels, '$.scrape_target') AS target, seq // 8 AS seq, count(*) AS n FROM hot_samples GROUP BY 1, 2))
GROUP BY 1 HAVING sum(greatest(s - 5000, 0) - greatest(s - n - 5000, 0)) > 0""")
def _(c: Inputs):
    pushes = c.hot.groupBy(label("scrape_target").alias("target"), F.expr("seq div 8").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    return ring.eviction_counts(pushes, 5000)


# Series work.

@query("counter_diffs", """SELECT series_key, ts_us, greatest(0, v - pv) AS diff FROM (
  SELECT concat(name, labels) AS series_key, epoch_us(ts) AS ts_us, v, lag(v) OVER (PARTITION BY name, labels ORDER BY ts, seq) AS pv
  FROM (SELECT *, CASE WHEN isfinite(value) THEN value END AS v FROM hot_samples))
WHERE v IS NOT NULL AND pv IS NOT NULL""")
def _(c: Inputs):
    rows = c.keyed.select("series_key", micros("ts").alias("ts_us"), "seq", "value")
    return counter_diffs(rows, seq="seq").select("series_key", "ts_us", "diff")


@query("first_last_delta", """SELECT concat(name, labels) AS series_key, greatest(0, arg_max(value, seq) - arg_min(value, seq)) AS delta
FROM hot_samples WHERE isfinite(value) GROUP BY 1""")
def _(c: Inputs):
    rows = c.keyed.select("series_key", micros("ts").alias("ts_us"), "seq", "value")
    return first_last_delta(rows, seq="seq").select("series_key", "delta")


@query("companion_merge", """SELECT ts_us AS bucket_us, coalesce(sum(diff) FILTER (WHERE name = 'http_requests_total'), 0) AS reqs,
  round(CASE WHEN sum(diff) FILTER (WHERE name = 'http_request_duration_ms_count') > 0 THEN
    coalesce(sum(diff) FILTER (WHERE name = 'http_request_duration_ms_sum'), 0) /
    sum(diff) FILTER (WHERE name = 'http_request_duration_ms_count') END, 6) AS avg_ms
FROM hot_diffs WHERE name LIKE 'http%' GROUP BY 1""")
def _(c: Inputs):
    names = (hot.REQUESTS, hot.DURATION_SUM, hot.DURATION_COUNT)
    diffs = counter_diffs(_points(c).filter(P.named_any(names)), chunk_us=None)
    return rounded(hot.merge_companions(diffs, names).drop("p99_ms"), "avg_ms")


@query("sort_points", """SELECT concat(name, labels) AS series_key, string_agg(CAST(ts_us AS VARCHAR), ',' ORDER BY ts_us) AS times
FROM hot_points WHERE name = 'visitors_total' GROUP BY 1""")
def _(c: Inputs):
    rows = sinks.matrix(_points(c).filter(P.named("visitors_total")))
    times = F.transform("values", lambda p: F.round(p["t"] * 1e6).cast("bigint").cast("string"))
    return rows.select("series_key", F.array_join(times, ",").alias("times"))


# Reports.

@query("hot_throughput", "SELECT bucket_us, reqs, round(avg_ms, 6) AS avg_ms, CAST(NULL AS DOUBLE) AS p99_ms FROM hot_throughput_rows ORDER BY 1")
def _(c: Inputs):
    return rounded(hot.throughput(_points(c)), "avg_ms")


@query("hot_error_distribution", "SELECT path, c4xx, c5xx, total FROM hot_error_rows")
def _(c: Inputs):
    return hot.error_distribution(_points(c))


_VISITORS = """SELECT coalesce(min(ts_us) FILTER (WHERE name = 'visitors_total'), min(ts_us)) AS bucket_us, target, region,
  arg_max(value, ts_us) FILTER (WHERE name = 'visitors_total') AS visitors,
  arg_max(value, ts_us) FILTER (WHERE name = 'unique_visitors_estimate') AS uniques FROM (
  SELECT *, ts_us // 1000000 AS s, json_extract_string(labels, '$.scrape_target') AS target,
    json_extract_string(labels, '$.region') AS region FROM hot_points
  WHERE name IN ('visitors_total', 'unique_visitors_estimate') AND isfinite(value)) GROUP BY s, target, region"""


@query("hot_visitors", f"{_VISITORS} ORDER BY 1, 2, 3")
def _(c: Inputs):
    return hot.visitors(_points(c))


@query("visitor_merge", f"SELECT target, region, count(*) AS cells, count(visitors) AS with_visitors, count(uniques) AS with_uniques FROM ({_VISITORS}) GROUP BY 1, 2")
def _(c: Inputs):
    return hot.visitors(_points(c)).groupBy("target", "region").agg(
        F.count(F.lit(1)).alias("cells"), F.count("visitors").alias("with_visitors"), F.count("uniques").alias("with_uniques")
    )


@query("hot_custom", """SELECT ts_us AS bucket_us, round(avg(value), 6) AS v, count(*) AS n FROM hot_points
WHERE name = 'http_requests_total' AND isfinite(value) GROUP BY 1 ORDER BY 1""")
def _(c: Inputs):
    return rounded(hot.custom(_points(c).filter(P.named(hot.REQUESTS))), "v")


_SUMMARY = """SELECT total, round(weighted / weight, 6) AS avg_ms, peak / step AS peak_per_sec,
  CASE WHEN total > 0 THEN errs / total ELSE 0 END AS error_rate, errs AS error_count FROM (
  SELECT sum(reqs) AS total, sum(avg_ms * reqs) AS weighted, sum(CASE WHEN avg_ms IS NOT NULL THEN reqs END) AS weight,
    max(reqs) AS peak, (SELECT sum(c4xx + c5xx) FROM hot_error_all) AS errs FROM hot_throughput_rows), hot_plan"""


@query("hot_summary", f"SELECT total, avg_ms, round(peak_per_sec, 9) AS peak_per_sec, round(error_rate, 9) AS error_rate, error_count FROM ({_SUMMARY})")
def _(c: Inputs):
    plan = hot.plan_window(c.hot, "7d", c.as_of)
    points = hot.dashboard_points(c.hot, plan)
    out = hot.summary(hot.throughput(points), hot.error_counts(points), plan.step)
    return rounded(rounded(out, "avg_ms"), "peak_per_sec", "error_rate", digits=9)


@query("hot_dashboard", f"""SELECT 'throughput' AS report, count(*) AS n, sum(reqs) AS total FROM hot_throughput_rows
UNION ALL SELECT 'errors', count(*), sum(c4xx + c5xx) FROM hot_error_rows
UNION ALL SELECT 'names', count(DISTINCT name), NULL FROM hot_samples
UNION ALL SELECT 'visitors', count(*), sum(visitors) FROM ({_VISITORS})
UNION ALL SELECT 'summary', 1, total FROM ({_SUMMARY})""")
def _(c: Inputs):
    d = hot.dashboard(c.hot, "7d", c.as_of)
    totals = {"throughput": "reqs", "errors": "c4xx + c5xx", "names": "CAST(NULL AS DOUBLE)", "visitors": "visitors", "summary": "total"}
    parts = [
        d[k].agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(e)).cast("double").alias("total")).select(F.lit(k).alias("report"), "n", "total")
        for k, e in totals.items()
    ]
    return union_by_name(parts)


def _span_plan(seconds: int) -> str:
    return f"""SELECT greatest(epoch_us((SELECT t FROM as_of)) - {seconds}000000, epoch_us(arg_min(ts, seq))) AS start_us, epoch_us(arg_max(ts, seq)) AS end_us
  FROM hot_samples"""


def _span_points(seconds: int, where: str) -> str:
    """Points of a shorter window, optionally narrowed by a label."""
    return f"""SELECT name, labels, ts_us, value FROM (
  SELECT h.*, epoch_us(h.ts) AS ts_us, row_number() OVER (PARTITION BY h.name, h.labels, (epoch_us(h.ts) - p.start_us) // (p.step * 1000000)
    ORDER BY h.ts DESC, h.seq DESC) AS rn
  FROM hot_samples h, (SELECT *, CAST(greatest(15, ceil(greatest(0, end_us - start_us) / 240000000.0)) AS BIGINT) AS step FROM ({_span_plan(seconds)})) p
  WHERE epoch_us(h.ts) BETWEEN p.start_us AND p.end_us AND {where}) WHERE rn = 1"""


def _window_report(name: str, key: str, seconds: int, target: str, where: str) -> None:
    @query(name, f"""SELECT ts_us AS bucket_us, coalesce(sum(diff) FILTER (WHERE name = 'http_requests_total'), 0) AS reqs FROM (
  SELECT name, ts_us, greatest(0, v - lag(v) OVER (PARTITION BY name, labels ORDER BY ts_us)) AS diff FROM (
    SELECT *, CASE WHEN isfinite(value) THEN value END AS v FROM ({_span_points(seconds, where)})
    WHERE name LIKE 'http%') QUALIFY v IS NOT NULL AND lag(v) OVER (PARTITION BY name, labels ORDER BY ts_us) IS NOT NULL) GROUP BY 1""")
    def _(c: Inputs):
        points = hot.dashboard_points(c.hot, hot.plan_window(c.hot, key, c.as_of), target)
        return hot.throughput(points).select("bucket_us", "reqs")


_window_report("hot_throughput_1h", "1h", 3600, "", "true")
_window_report("hot_throughput_24h_target", "24h", 86_400, "app3", "json_extract_string(h.labels, '$.scrape_target') = 'app3'")


@query("hot_custom_matched", f"""SELECT ts_us AS bucket_us, round(avg(value), 6) AS v, count(*) AS n FROM (
  {_span_points(86_400, "h.name = 'http_requests_total' AND json_extract_string(h.labels, '$.status') = '500'")})
WHERE isfinite(value) GROUP BY 1""")
def _(c: Inputs):
    return rounded(hot.run_custom(c.hot, hot.REQUESTS, "24h", c.as_of, {"status": "500"}), "v")


# Rendering.

@query("matrix_json", """SELECT series_key, concat('{"metric":{"__name__":"visitors_total",', substr(labels, 2), ',"values":[',
  string_agg(concat('[', ts_us // 1000000, '.', lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0'), ',"', CAST(value AS BIGINT), '"]'), ',' ORDER BY ts_us),
  ']}') AS entry, false AS clamped FROM (SELECT *, concat(name, labels) AS series_key FROM hot_points WHERE name = 'visitors_total')
GROUP BY series_key, labels""")
def _(c: Inputs):
    return sinks.matrix_json(_points(c).filter(P.named("visitors_total")))


@query("prom_text", """SELECT concat(name, '{', array_to_string(list_transform(json_keys(labels),
    lambda k: concat(k, '="', json_extract_string(labels, concat('$.', k)), '"')), ','), '} ',
  CASE WHEN isnan(value) THEN 'NaN' ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END) AS value FROM (
  SELECT name, labels, arg_max(value, seq) AS value FROM hot_samples GROUP BY 1, 2)""")
def _(c: Inputs):
    return sinks.prom_text(c.hot)


