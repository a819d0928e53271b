"""History reports, predicates, scalar functions and chart shapes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gaugeline.functions import labels as L, predicates as P, scalars as S
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.operators.series import running_total
from gaugeline.operators import grid
from gaugeline.plans import cold, shaping
from gaugeline.sources import metrics as M

from .base import Inputs, query, rounded

_HOUR = "epoch_us(date_trunc('hour', ts))"
_DAY = "epoch_us(date_trunc('day', ts))"
_SINCE = "ts >= (SELECT t FROM as_of) - INTERVAL 24 HOUR"
_PATH = "coalesce(nullif(json_extract_string(labels, '$.path'), ''), '(unknown)')"
_TARGET = "coalesce(nullif(json_extract_string(labels, '$.scrape_target'), ''), '(unknown)')"
_REGION = "coalesce(nullif(json_extract_string(labels, '$.region'), ''), '(unknown)')"


def _throughput(bucket: str, rows: str = "metrics_all") -> str:
    """Buckets that have a row of any metric, with the requests and the latency of each."""
    latency = f"""SELECT {bucket} AS bucket_us, avg(value) AS avg_ms, quantile_cont(value, 0.99) AS p99_ms FROM {rows}
  WHERE name = 'http_request_duration_ms' GROUP BY 1"""
    return f"""SELECT bucket_us, coalesce(reqs, 0) AS reqs, avg_ms, p99_ms FROM (SELECT DISTINCT {bucket} AS bucket_us FROM {rows})
LEFT JOIN (SELECT {bucket} AS bucket_us, count(*) AS reqs FROM {rows} WHERE name = 'http_requests_total' GROUP BY 1) USING (bucket_us)
LEFT JOIN ({latency}) USING (bucket_us)"""


def _rounded_throughput(bucket: str, where: str | None = None) -> str:
    rows = f"(SELECT * FROM metrics_all WHERE {where})" if where else "metrics_all"
    return f"SELECT bucket_us, reqs, round(avg_ms, 6) AS avg_ms, round(p99_ms, 6) AS p99_ms FROM ({_throughput(bucket, rows)})"


_THROUGHPUT = _throughput(_DAY)
_KINDS = f"""SELECT {_PATH} AS path, left(json_extract_string(labels, '$.status'), 1) AS kind, count(*) AS n
  FROM metrics_all WHERE name = 'http_requests_total' GROUP BY 1, 2"""
_ERRORS = f"""SELECT path, CAST(sum(if(kind = '4', n, 0)) AS BIGINT) AS c4xx, CAST(sum(if(kind = '5', n, 0)) AS BIGINT) AS c5xx,
  CAST(sum(n) AS BIGINT) AS total FROM ({_KINDS}) GROUP BY 1"""
_TOP = f"SELECT * FROM ({_ERRORS}) WHERE c4xx + c5xx > 0 ORDER BY c4xx + c5xx DESC, path LIMIT 20"
_CELL = f"{_DAY} AS bucket_us, {_TARGET} AS target, {_REGION} AS region"


def _last(name: str, alias: str) -> str:
    return f"""SELECT {_CELL}, arg_max(value, ts) AS {alias} FROM metrics_all WHERE name = '{name}' AND value IS NOT NULL GROUP BY 1, 2, 3"""


_VISITORS = f"""SELECT bucket_us, target, region, visitors, uniques FROM (
  SELECT DISTINCT {_CELL} FROM metrics_all WHERE name IN ('visitors_total', 'unique_visitors_estimate'))
LEFT JOIN ({_last('visitors_total', 'visitors')}) USING (bucket_us, target, region)
LEFT JOIN ({_last('unique_visitors_estimate', 'uniques')}) USING (bucket_us, target, region)"""
_SUMMARY = f"""SELECT total, round(weighted / weight, 6) AS avg_ms, peak / 86400 AS peak_per_sec,
  round(CASE WHEN total > 0 THEN errs / total ELSE 0 END, 9) AS error_rate, errs AS error_count FROM (
  SELECT CAST(sum(reqs) AS DOUBLE) AS total, sum(avg_ms * reqs) AS weighted,
    sum(CASE WHEN avg_ms IS NOT NULL THEN reqs END) AS weight, CAST(max(reqs) AS DOUBLE) AS peak,
    (SELECT CAST(sum(c4xx + c5xx) AS DOUBLE) FROM ({_ERRORS})) AS errs
  FROM ({_THROUGHPUT}))"""


@query("cold_throughput_latency", _rounded_throughput(_HOUR, _SINCE))
def _(c: Inputs):
    return rounded(cold.throughput_latency(c.metrics, "24h", c.as_of), "avg_ms", "p99_ms")


@query("cold_throughput_latency_all", _rounded_throughput(_DAY))
def _(c: Inputs):
    return rounded(cold.throughput_latency(c.metrics, "all", c.as_of), "avg_ms", "p99_ms")


@query("cold_throughput_latency_hour", _rounded_throughput("epoch_us(date_trunc('minute', ts))", "ts >= (SELECT t FROM as_of) - INTERVAL 1 HOUR"))
def _(c: Inputs):
    return rounded(cold.throughput_latency(c.metrics, "1h", c.as_of), "avg_ms", "p99_ms")


@query("cold_throughput_latency_target", _rounded_throughput(_DAY, "json_extract_string(labels, '$.scrape_target') = 'app3'"))
def _(c: Inputs):
    return rounded(cold.throughput_latency(c.metrics, "all", c.as_of, " app3 "), "avg_ms", "p99_ms")


@query("cold_error_distribution", _TOP)
def _(c: Inputs):
    return cold.error_distribution(c.metrics, "all", c.as_of)


@query("having_errors", f"SELECT * FROM ({_ERRORS}) WHERE c4xx + c5xx > 0")
def _(c: Inputs):
    return cold.error_counts(c.metrics, "all", c.as_of)


@query("topk_errors", f"SELECT * FROM ({_ERRORS}) ORDER BY c4xx + c5xx DESC, path LIMIT 5")
def _(c: Inputs):
    return cold.top_errors(cold.error_counts(c.metrics, "all", c.as_of, errors_only=False), 5)


@query("cold_metric_names", "SELECT DISTINCT name FROM metrics_all ORDER BY 1 LIMIT 200")
def _(c: Inputs):
    return cold.metric_names(c.metrics)


@query("limit_names", "SELECT DISTINCT json_extract_string(labels, '$.path') AS name FROM metrics_all "
       "WHERE name = 'http_requests_total' ORDER BY 1 LIMIT 12")
def _(c: Inputs):
    paths = c.metrics.filter(P.named(cold.REQUESTS)).select(L.label("path").alias("name"))
    return cold.metric_names(paths, 12)


@query("cold_targets", f"SELECT DISTINCT {_TARGET} AS target FROM metrics_all WHERE name = 'http_requests_total' ORDER BY 1")
def _(c: Inputs):
    return cold.targets(c.metrics)


@query("cold_visitors_by_region", f"{_VISITORS} ORDER BY 1, 2, 3")
def _(c: Inputs):
    return cold.visitors_by_region(c.metrics, "all", c.as_of)


_CUSTOM = {
    "avg": "round(avg(value), 6)", "sum": "round(sum(value), 6)", "min": "min(value)", "max": "max(value)",
    "count": "count(*)", "p50": "round(quantile_cont(value, 0.5), 6)", "p99": "round(quantile_cont(value, 0.99), 6)",
}


def _custom(agg: str, expression: str) -> None:
    @query(f"cold_custom_{agg}", f"""SELECT {_HOUR} AS bucket_us, {expression} AS v, count(*) AS n FROM metrics_all
WHERE name = 'http_request_duration_ms' AND json_extract_string(labels, '$.path') = '/view' GROUP BY 1 ORDER BY 1""")
    def _(c: Inputs):
        out = cold.custom_series(c.metrics, cold.DURATION, "other", c.as_of, agg, "path", " /view ")
        return out if agg in ("count", "min", "max") else rounded(out, "v")


for _agg, _expression in _CUSTOM.items():
    _custom(_agg, _expression)


@query("cold_custom_label_present", f"""SELECT {_DAY} AS bucket_us, sum(value) AS v, count(*) AS n FROM metrics_all
WHERE name = 'http_requests_total' AND json_extract_string(labels, '$.path') <> ''
  AND json_extract_string(labels, '$.scrape_target') = 'app7' GROUP BY 1 ORDER BY 1""")
def _(c: Inputs):
    return cold.custom_series(c.metrics, cold.REQUESTS, "all", c.as_of, "sum", "path", "", "app7")


@query("cold_summary", _SUMMARY)
def _(c: Inputs):
    t = cold.throughput_latency(c.metrics, "all", c.as_of)
    out = cold.summary(t, cold.error_counts(c.metrics, "all", c.as_of), P.range_bucket_seconds("all"))
    return out.withColumns({"avg_ms": F.round("avg_ms", 6), "error_rate": F.round("error_rate", 9)})


@query("cold_normalise", f"""SELECT bucket_us, target, region, visitors, uniques FROM (
  SELECT bucket_us, coalesce(target, '(unknown)') AS target, coalesce(region, '(unknown)') AS region, visitors, uniques
  FROM ({_VISITORS}))""")
def _(c: Inputs):
    blank = cold.visitors_by_region(c.metrics, "all", c.as_of)
    return cold.normalise(blank.withColumn("target", F.nullif("target", F.lit("(unknown)"))))


@query("cold_dashboard", f"""SELECT 'throughput' AS report, count(*) AS n, CAST(sum(reqs) AS DOUBLE) AS total FROM ({_THROUGHPUT})
UNION ALL SELECT 'errors', count(*), CAST(sum(c4xx + c5xx) AS DOUBLE) FROM ({_TOP})
UNION ALL SELECT 'names', count(DISTINCT name), NULL FROM metrics_all
UNION ALL SELECT 'visitors', count(*), CAST(sum(visitors) AS DOUBLE) FROM ({_VISITORS})
UNION ALL SELECT 'summary', 1, total FROM ({_SUMMARY})""")
def _(c: Inputs):
    d = cold.dashboard(c.metrics, "all", c.as_of)
    totals = {"throughput": "reqs", "errors": "c4xx + c5xx", "names": "CAST(NULL AS DOUBLE)", "visitors": "visitors", "summary": "total"}
    parts = [
        d[k].agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(e)).cast("double").alias("total")).select(F.lit(k).alias("report"), "n", "total")
        for k, e in totals.items()
    ]
    return M.union_by_name(parts)


@query("order_by_bucket", f"SELECT {_HOUR} AS bucket_us, sum(value) AS v, count(*) AS n FROM metrics_all "
       "WHERE name = 'http_requests_total' GROUP BY 1 ORDER BY 1")
def _(c: Inputs):
    return cold.custom_series(c.metrics, cold.REQUESTS, "", c.as_of, "sum")


# Predicates.

@query("filter_name", "SELECT ts, value, labels FROM metrics_all WHERE name = 'visitors_total'")
def _(c: Inputs):
    return c.metrics.filter(P.named(cold.VISITORS)).select("ts", "value", "labels")


@query("filter_name_in", "SELECT name, ts, value FROM metrics_all WHERE name IN ('visitors_total', 'unique_visitors_estimate')")
def _(c: Inputs):
    return c.metrics.filter(P.named_any([cold.VISITORS, cold.UNIQUES])).select("name", "ts", "value")


@query("filter_matchers", """SELECT ts, value, labels FROM metrics_all WHERE name = 'http_requests_total'
  AND json_extract_string(labels, '$.method') = 'GET' AND json_extract_string(labels, '$.status') = '500'""")
def _(c: Inputs):
    m = c.metrics.filter(P.named(cold.REQUESTS))
    return m.filter(P.matches(m, {"method": "GET", "status": "500"})).select("ts", "value", "labels")


@query("filter_matchers_absent", """SELECT name, count(*) AS n FROM metrics_all
WHERE json_extract_string(labels, '$.path') = '' GROUP BY 1""")
def _(c: Inputs):
    m = c.metrics
    return m.filter(P.matches(m, {"path": ""})).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("filter_time_closed", """SELECT name, ts, value FROM metrics_all
WHERE ts BETWEEN (SELECT t FROM as_of) - INTERVAL 48 HOUR AND (SELECT t FROM as_of) - INTERVAL 12 HOUR""")
def _(c: Inputs):
    m, now = c.metrics, c.as_of
    return m.filter(P.between_closed(m, now - dt.timedelta(hours=48), now - dt.timedelta(hours=12))).select("name", "ts", "value")


@query("filter_range_key", f"SELECT name, ts, value FROM metrics_all WHERE {_SINCE}")
def _(c: Inputs):
    return c.metrics.filter(P.in_range(c.metrics, "24h", c.as_of)).select("name", "ts", "value")


@query("interval_sub", "SELECT name, ts FROM metrics_all WHERE ts >= (SELECT t FROM as_of) - INTERVAL 1 HOUR")
def _(c: Inputs):
    return c.metrics.filter(P.in_range(c.metrics, "1h", c.as_of)).select("name", "ts")


@query("filter_target", "SELECT name, ts, value FROM metrics_all WHERE json_extract_string(labels, '$.scrape_target') = 'app5'")
def _(c: Inputs):
    return c.metrics.filter(P.of_target(c.metrics, " app5")).select("name", "ts", "value")


@query("filter_label_present", "SELECT name, ts, value FROM metrics_all WHERE json_extract_string(labels, '$.path') <> ''")
def _(c: Inputs):
    return c.metrics.filter(P.has_label(c.metrics, " path ")).select("name", "ts", "value")


@query("status_class", """SELECT json_extract_string(labels, '$.status') AS status,
  json_extract_string(labels, '$.status') LIKE '4%' AS is4, json_extract_string(labels, '$.status') LIKE '5%' AS is5, count(*) AS n
FROM metrics_all WHERE name = 'http_requests_total' GROUP BY 1, 2, 3""")
def _(c: Inputs):
    rows = c.metrics.filter(P.named(cold.REQUESTS)).select(L.label("status").alias("status"))
    return rows.groupBy("status", P.status_class(F.col("status"), "4").alias("is4"), P.status_class(F.col("status"), "5").alias("is5")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("like_prefix", "SELECT event_id FROM events WHERE event_type LIKE 'er%'")
def _(c: Inputs):
    return c.table("events").filter(F.col("event_type").startswith("er")).select("event_id")


@query("drop_non_finite", "SELECT seq, name, CASE WHEN isfinite(value) THEN value END AS value FROM hot_samples")
def _(c: Inputs):
    return c.hot.select("seq", "name", S.finite_or_null("value").alias("value"))


@query("count_filter", """SELECT name, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value IS NULL) AS missing,
  count(*) AS n FROM metrics_all GROUP BY 1""")
def _(c: Inputs):
    return c.metrics.groupBy("name").agg(
        F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value").isNull()).alias("missing"), F.count(F.lit(1)).alias("n")
    )


@query("quantile_exact", """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def _(c: Inputs):
    out = exact_quantiles(c.table("events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return rounded(out, "p50", "p90", "p99")


@query("quantile_exact_prices", """SELECT o_orderpriority, round(quantile_cont(o_totalprice - 250000, 0.25), 4) AS p25,
  round(quantile_cont(o_totalprice - 250000, 0.75), 4) AS p75 FROM orders GROUP BY 1""")
def _(c: Inputs):
    prices = c.table("orders").withColumn("delta", F.col("o_totalprice") - 250000)
    out = exact_quantiles(prices, ["o_orderpriority"], "delta", {"p25": 0.25, "p75": 0.75}, direct_rows=100)
    return rounded(out, "p25", "p75", digits=4)


@query("distinct_values", "SELECT DISTINCT name, metric_type FROM metrics_all")
def _(c: Inputs):
    return c.metrics.select("name", "metric_type").distinct()


@query("running_total", """SELECT event_id, region, CAST(sum(units) OVER (PARTITION BY region ORDER BY event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (
  SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'DE' ELSE 'US' END AS region, CAST(floor(value) AS BIGINT) AS units FROM events)""")
def _(c: Inputs):
    rows = c.table("events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, "DE").otherwise("US").alias("region"), F.floor("value").alias("units")
    )
    return running_total(rows, ["region"], "event_id", "units", 1 << 20).select("event_id", "region", "running")


@query("union_all", """SELECT name, count(*) AS n, round(sum(value), 4) AS total FROM metrics_all GROUP BY 1""")
def _(c: Inputs):
    parts = [c.metrics.filter(P.named(n)) for n in (cold.REQUESTS, cold.DURATION, cold.VISITORS, cold.UNIQUES)]
    return M.union_by_name(parts).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("union_by_name", """SELECT event_id AS id, value, event_type AS tag, NULL::BIGINT AS custkey FROM events
UNION ALL SELECT o_orderkey, o_totalprice, NULL, o_custkey FROM orders""")
def _(c: Inputs):
    a = c.table("events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("id"), "value")
    b = c.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("custkey"))
    return M.union_by_name([a, b])


@query("distinct_sorted", "SELECT DISTINCT trim(name) AS name FROM dynamic_targets WHERE trim(name) <> '' ORDER BY 1")
def _(c: Inputs):
    names = c.view("dynamic_targets").select(F.trim("name").alias("name"))
    return names.filter("name <> ''").distinct().orderBy("name")


@query("bucket_spine", """SELECT region, bucket, coalesce(n, 0) AS n FROM (
  SELECT r.region, b.bucket FROM (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'DE' ELSE 'US' END AS region FROM events) r
  CROSS JOIN (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS bucket FROM events) b)
LEFT JOIN (SELECT CASE WHEN user_id % 2 = 0 THEN 'DE' ELSE 'US' END AS region, date_trunc('hour', ts) AS bucket, count(*) AS n
  FROM events GROUP BY 1, 2) USING (region, bucket)""")
def _(c: Inputs):
    rows = c.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("region", F.when(F.col("user_id") % 2 == 0, "DE").otherwise("US"))
    spine = grid.bucket_spine(rows, rows.select("region"))
    counts = rows.groupBy("region", F.date_trunc("hour", "ts").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    filled = grid.fill_gaps(spine, counts, ["region", "bucket"])
    return filled.select("region", F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("lateral_expand", "SELECT event_id, unnest(generate_series(1, event_id % 4)) AS i FROM events")
def _(c: Inputs):
    return grid.lateral_expand(c.table("events").select("event_id"), F.col("event_id") % 4)


# Scalar functions.

@query("label_get", "SELECT ts, name, json_extract_string(labels, '$.path') AS path, json_extract_string(labels, '$.method') AS method FROM metrics_all")
def _(c: Inputs):
    return c.metrics.select("ts", "name", L.label("path").alias("path"), L.label("method").alias("method"))


@query("label_or_unknown", f"SELECT {_PATH} AS path, {_REGION} AS region, count(*) AS n FROM metrics_all GROUP BY 1, 2")
def _(c: Inputs):
    return c.metrics.groupBy(L.or_unknown(L.label("path")).alias("path"), L.or_unknown(L.label("region")).alias("region")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("bucket_us", f"SELECT event_id, epoch_us(date_trunc('minute', ts)) AS m, {_HOUR} AS h, {_DAY} AS d FROM events")
def _(c: Inputs):
    return c.table("events").select("event_id", S.bucket_us("minute").alias("m"), S.bucket_us("hour").alias("h"), S.bucket_us("day").alias("d"))


@query("to_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def _(c: Inputs):
    return c.table("events").select("event_id", S.epoch_ms(S.micros("ts")).alias("ms"))


@query("clamp_zero", "SELECT seq, CASE WHEN value IS NOT NULL THEN greatest(0, value - 300) END AS v FROM hot_samples WHERE isfinite(value)")
def _(c: Inputs):
    rows = c.hot.filter(S.finite_or_null("value").isNotNull())
    return rows.select("seq", S.clamp_zero(F.col("value") - 300).alias("v"))


@query("step_seconds", """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST((event_id % 50 + 1) AS DOUBLE) *
  CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 ELSE 604800 END END AS seconds FROM events""")
def _(c: Inputs):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "h", "d", "w", "ms")]), (F.col("event_id") % 6 + 1).cast("int"))
    return c.table("events").select("event_id", S.step_seconds(F.concat((F.col("event_id") % 50 + 1).cast("string"), unit)).alias("seconds"))


@query("prom_float", "SELECT seq, CASE WHEN isnan(value) THEN 'NaN' ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS v FROM hot_samples")
def _(c: Inputs):
    return c.hot.select("seq", S.prom_float("value").alias("v"))


@query("prom_float_fractions", r"SELECT o_orderkey, regexp_replace(CAST(o_totalprice / 8 AS VARCHAR), '\.0$', '') AS v, regexp_replace(CAST(o_totalprice / 3 AS VARCHAR), '\.0$', '') AS w FROM orders")
def _(c: Inputs):
    price = F.col("o_totalprice")
    return c.table("orders").select("o_orderkey", S.prom_float(price / 8).alias("v"), S.prom_float(price / 3).alias("w"))


@query("round2", "SELECT o_orderkey, round(o_totalprice / 3, 2) AS v FROM orders")
def _(c: Inputs):
    return c.table("orders").select("o_orderkey", S.round2(F.col("o_totalprice") / 3).alias("v"))


@query("labels_json", """SELECT event_id, concat('{"a":"', user_id, '","b":"', event_type, '","c":"', event_id % 3, '"}') AS labels FROM events""")
def _(c: Inputs):
    pairs = F.create_map(F.lit("c"), (F.col("event_id") % 3).cast("string"), F.lit("b"), "event_type", F.lit("a"), F.col("user_id").cast("string"))
    return c.table("events").select("event_id", L.labels_json(pairs).alias("labels"))


@query("labels_sort", """SELECT event_id, concat('a=', user_id, ',b=', event_type, ',c=', event_id % 3) AS pairs FROM events""")
def _(c: Inputs):
    pairs = F.create_map(F.lit("c"), (F.col("event_id") % 3).cast("string"), F.lit("b"), "event_type", F.lit("a"), F.col("user_id").cast("string"))
    text = F.transform(L.sorted_pairs(pairs), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return c.table("events").select("event_id", F.array_join(text, ",").alias("pairs"))


@query("math", """SELECT event_id, CAST(floor(value) AS BIGINT) AS fl, CAST(ceil(value) AS BIGINT) AS ce, round(value, 1) AS ro,
  round(cos(extract(epoch FROM date_trunc('minute', ts)) / 7000.0), 6) AS co, round(ln(value + 1), 6) AS lo FROM events""")
def _(c: Inputs):
    minute = F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    return c.table("events").select(
        "event_id", F.floor("value").alias("fl"), F.ceil("value").alias("ce"), F.round("value", 1).alias("ro"),
        F.round(F.cos(minute / 7000.0), 6).alias("co"), F.round(F.ln(F.col("value") + 1), 6).alias("lo"),
    )


@query("array_index", "SELECT event_id, (['north', 'east', 'south', 'west', 'centre'])[1 + event_id % 5] AS side FROM events")
def _(c: Inputs):
    sides = F.array(*[F.lit(p) for p in ("north", "east", "south", "west", "centre")])
    return c.table("events").select("event_id", F.element_at(sides, (F.col("event_id") % 5 + 1).cast("int")).alias("side"))


# Chart shapes.

@query("latency_series", f"""SELECT * FROM (
  SELECT bucket_us // 1000 AS ms, 'avg' AS series, round(avg_ms, 2) AS value FROM ({_THROUGHPUT})
  UNION ALL SELECT bucket_us // 1000, 'p99', round(p99_ms, 2) FROM ({_THROUGHPUT})) WHERE value IS NOT NULL""")
def _(c: Inputs):
    return shaping.latency_series(cold.throughput_latency(c.metrics, "all", c.as_of))


@query("visitor_series", f"""SELECT * FROM (
  SELECT concat(target, ' / ', region, ' uniques') AS series, bucket_us // 1000 AS ms, uniques AS value FROM ({_VISITORS})
  UNION ALL SELECT concat(target, ' / ', region, ' total'), bucket_us // 1000, visitors FROM ({_VISITORS})) WHERE value IS NOT NULL""")
def _(c: Inputs):
    return shaping.visitor_series(cold.visitors_by_region(c.metrics, "all", c.as_of))


@query("throughput_series", f"SELECT bucket_us // 1000 AS ms, CAST(reqs AS DOUBLE) AS value FROM ({_THROUGHPUT})")
def _(c: Inputs):
    return shaping.throughput_series(cold.throughput_latency(c.metrics, "all", c.as_of))


@query("custom_series", f"SELECT {_DAY} // 1000 AS ms, round(avg(value), 6) AS value FROM metrics_all WHERE name = 'http_request_duration_ms' GROUP BY 1")
def _(c: Inputs):
    return rounded(shaping.custom_series(cold.custom_series(c.metrics, cold.DURATION, "all", c.as_of)), "value")


@query("error_bars", f"""SELECT path, '4xx' AS series, CAST(c4xx AS DOUBLE) AS value FROM ({_TOP})
UNION ALL SELECT path, '5xx', CAST(c5xx AS DOUBLE) FROM ({_TOP})""")
def _(c: Inputs):
    return shaping.error_bars(cold.error_distribution(c.metrics, "all", c.as_of))
