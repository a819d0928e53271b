"""Registration, and the test inputs every query starts from.

The inputs are views over the given tables. The same text runs in both engines.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.session import prepare

TABLES = ("events", "orders", "customer", "supplier", "nation", "region")

_TARGET = "concat('app', user_id % 20)"
_REGION = "CASE WHEN user_id % 2 = 0 THEN 'DE' ELSE 'US' END"

VIEWS = {
    # History: requests, durations and the two visitor metrics.
    "metrics_all": f"""
SELECT ts, 'http_requests_total' AS name, CAST(1 AS DOUBLE) AS value, 'counter' AS metric_type,
  concat('{{"method":"', CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END,
    '","path":"', CASE WHEN event_type = 'signup' THEN '' ELSE concat('/', event_type, '/', event_id % 8) END,
    '","scrape_target":"', {_TARGET}, '","status":"',
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN '500'
         WHEN event_id % 17 = 0 THEN '404' ELSE '200' END, '"}}') AS labels
FROM events
UNION ALL
SELECT ts, 'http_request_duration_ms', value, 'histogram',
  concat('{{"method":"GET","path":"/', event_type, '","scrape_target":"', {_TARGET}, '"}}')
FROM events
UNION ALL
SELECT ts, 'visitors_total', CAST(event_id AS DOUBLE), 'counter',
  concat('{{"region":"', {_REGION}, '","scrape_target":"', {_TARGET}, '"}}')
FROM events WHERE event_type = 'view'
UNION ALL
SELECT ts, 'unique_visitors_estimate', CASE WHEN event_id % 10 = 0 THEN NULL ELSE floor(value) END, 'gauge',
  concat('{{"region":"', {_REGION}, '","scrape_target":"', {_TARGET}, '"}}')
FROM events WHERE event_type = 'click'""",
    # Recent samples: cumulative counters with resets and NaN gaps, and their companions.
    "hot_samples": f"""
SELECT event_id * 8 AS seq, ts, 'http_requests_total' AS name,
  CASE WHEN event_id % 41 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(event_id % 700 AS DOUBLE) END AS value,
  concat('{{"path":"/', event_type, '","scrape_target":"', {_TARGET}, '","status":"',
    CASE WHEN event_id % 5 = 0 THEN '500' WHEN event_id % 7 = 0 THEN '404' ELSE '200' END, '"}}') AS labels
FROM events
UNION ALL
SELECT event_id * 8 + 1, ts, 'http_request_duration_ms_sum', CAST(event_id * 25 + CAST(floor(value) AS BIGINT) AS DOUBLE),
  concat('{{"path":"/', event_type, '","scrape_target":"', {_TARGET}, '"}}')
FROM events
UNION ALL
SELECT event_id * 8 + 2, ts, 'http_request_duration_ms_count', CAST(event_id AS DOUBLE),
  concat('{{"path":"/', event_type, '","scrape_target":"', {_TARGET}, '"}}')
FROM events
UNION ALL
SELECT event_id * 8 + 3, ts, 'visitors_total', CAST(event_id AS DOUBLE),
  concat('{{"region":"', {_REGION}, '","scrape_target":"', {_TARGET}, '"}}')
FROM events WHERE event_type = 'view'
UNION ALL
SELECT event_id * 8 + 4, ts, 'unique_visitors_estimate', floor(value),
  concat('{{"region":"', {_REGION}, '","scrape_target":"', {_TARGET}, '"}}')
FROM events WHERE event_type = 'view'""",
    # One landed scrape per event; some failed, some too large.
    "scrape_payloads": f"""
SELECT concat({_TARGET}, '@', event_id) AS scrape_id, {_TARGET} AS target, ts AS scrape_ts, event_id * 100 AS seq,
  CASE WHEN event_id % 7 = 0 THEN 503 ELSE 200 END AS http_status,
  concat('# HELP http_requests_total n', chr(10), '# TYPE http_requests_total counter', chr(10),
    'http_requests_total{{status="200",path="/a,b",method="GET"}} ', event_id, chr(10),
    'http_requests_total{{path="/say ', chr(92), '"hi', chr(92), '"",status="500"}} ', event_id % 7, chr(10),
    '# TYPE http_request_duration_ms histogram', chr(10),
    'http_request_duration_ms_bucket{{le="25.0"}} ', event_id % 11, chr(10),
    'http_request_duration_ms_bucket{{le="100"}} ', event_id % 11 + 1, chr(10),
    'http_request_duration_ms_bucket{{le="+Inf"}} ', event_id % 11 + 2, chr(10),
    'http_request_duration_ms_sum ', CAST(floor(value) AS BIGINT), chr(10),
    'http_request_duration_ms_count ', event_id % 11 + 2, chr(10),
    '# TYPE http_rpc_ms summary', chr(10),
    'http_rpc_ms{{quantile="0.50"}} ', value, chr(10), 'http_rpc_ms{{quantile="0.990"}} 1e3', chr(10),
    '# TYPE unique_visitors_estimate gauge', chr(10),
    'unique_visitors_estimate{{region="DE",scrape_target="other"}} ', user_id, chr(10),
    'collector_scrape_total{{target="x"}} 1', chr(10), 'something_else 1', chr(10), 'not a sample line', chr(10),
    CASE WHEN event_id % 23 = 0 THEN repeat(concat('# padding', chr(10)), 200) ELSE '' END) AS body
FROM events""",
    "config_targets": """
SELECT concat('cfg:app', s_suppkey) AS id, concat('app', s_suppkey) AS name,
  concat('http://app', s_suppkey, ':8000/metrics') AS url,
  CASE WHEN s_suppkey % 3 = 0 THEN 'http_,unique_' WHEN s_suppkey % 3 = 1 THEN 'http_' ELSE '' END AS allow_csv,
  'recurring' AS mode, true AS enabled
FROM supplier""",
    "dynamic_targets": """
SELECT concat('t', c_custkey, ':0') AS id,
  CASE WHEN c_custkey % 50 = 0 THEN concat('app', c_custkey % 7) WHEN c_custkey % 40 = 1 THEN 'shared'
       WHEN c_custkey % 60 = 2 THEN ' ' ELSE concat('dyn', c_custkey) END AS name,
  CASE WHEN c_custkey % 45 = 3 THEN concat('ftp://dyn', c_custkey) WHEN c_custkey % 45 = 4 THEN 'http://a b/metrics'
       WHEN c_custkey % 45 = 5 THEN 'https://same/metrics' ELSE concat('https://dyn', c_custkey, '/metrics') END AS url,
  '' AS allow_csv, CASE WHEN c_custkey % 4 = 0 THEN 'once' ELSE 'recurring' END AS mode, c_custkey % 4 <> 0 AS enabled
FROM customer""",
    "override_log": """
SELECT concat('cfg:app', o_custkey % 150) AS id, o_orderkey AS seq,
  CASE WHEN o_orderkey % 5 = 0 THEN 'remove' WHEN o_orderkey % 2 = 0 THEN 'enable' ELSE 'disable' END AS op
FROM orders WHERE o_custkey % 150 > 2""",
    "scrape_outcomes": f"""
SELECT event_id AS attempt_seq, ts, {_TARGET} AS target,
  CASE WHEN event_type = 'error' THEN 'fetch_error' WHEN event_id % 29 = 0 THEN 'parse_error' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' OR event_id % 29 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS samples,
  CASE WHEN event_type <> 'error' AND event_id % 29 <> 0 AND event_id % 10 = 0 THEN 3 ELSE 0 END AS dropped,
  event_id % 500 AS duration_ms
FROM events""",
    "scrape_jobs": """
SELECT o_orderkey AS job_id, concat('app', o_custkey % 20) AS target,
  CASE WHEN o_orderkey % 4 = 0 THEN 'manual' ELSE 'scheduled' END AS kind,
  CASE WHEN o_orderkey % 97 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'done'
       WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 5000 = 1 THEN 'running' ELSE 'pending' END AS state,
  o_orderdate AS enqueued_at,
  CASE WHEN o_orderkey % 97 = 0 OR o_orderstatus IN ('F', 'P') THEN o_orderdate END AS finished_at
FROM orders""",
}

# Further views that only the DuckDB side uses.
_HOT_POINTS = """
SELECT name, labels, bucket, ts_us, value FROM (
  SELECT h.name, h.labels, (epoch_us(h.ts) - p.start_us) // (p.step * 1000000) AS bucket, epoch_us(h.ts) AS ts_us, h.value,
    row_number() OVER (PARTITION BY h.name, h.labels, (epoch_us(h.ts) - p.start_us) // (p.step * 1000000)
      ORDER BY h.ts DESC, h.seq DESC) AS rn
  FROM hot_samples h, hot_plan p WHERE epoch_us(h.ts) BETWEEN p.start_us AND p.end_us) WHERE rn = 1"""
ORACLE_VIEWS = {
    **VIEWS,
    "as_of": "SELECT date_trunc('second', max(ts)) + INTERVAL 1 SECOND AS t FROM events",
    "hot_plan": """
SELECT start_us, end_us, CAST(greatest(15, ceil((end_us - start_us) / 240000000.0)) AS BIGINT) AS step FROM (
  SELECT greatest(epoch_us((SELECT t FROM as_of)) - 604800000000, epoch_us(arg_min(ts, seq))) AS start_us,
    epoch_us(arg_max(ts, seq)) AS end_us FROM hot_samples)""",
    "hot_points": _HOT_POINTS,
    "hot_diffs": """
SELECT name, labels, ts_us, greatest(0, v - pv) AS diff FROM (
  SELECT name, labels, ts_us, v, lag(v) OVER (PARTITION BY name, labels ORDER BY ts_us) AS pv FROM (
    SELECT name, labels, ts_us, CASE WHEN isfinite(value) THEN value END AS v FROM hot_points))
WHERE v IS NOT NULL AND pv IS NOT NULL""",
    "hot_throughput_rows": """
SELECT ts_us AS bucket_us, reqs, CASE WHEN c > 0 THEN s / c END AS avg_ms FROM (
  SELECT ts_us, coalesce(sum(diff) FILTER (WHERE name = 'http_requests_total'), 0) AS reqs,
    coalesce(sum(diff) FILTER (WHERE name = 'http_request_duration_ms_sum'), 0) AS s,
    coalesce(sum(diff) FILTER (WHERE name = 'http_request_duration_ms_count'), 0) AS c
  FROM hot_diffs WHERE name IN ('http_requests_total', 'http_request_duration_ms_sum', 'http_request_duration_ms_count')
  GROUP BY 1)""",
    "hot_error_rows": "SELECT * FROM hot_error_all ORDER BY c4xx + c5xx DESC, path LIMIT 20",
    "hot_error_all": """
SELECT path, c4xx, c5xx, total FROM (
  SELECT path, sum(CASE WHEN status LIKE '4%' THEN d ELSE 0 END) AS c4xx,
    sum(CASE WHEN status LIKE '5%' THEN d ELSE 0 END) AS c5xx, sum(d) AS total FROM (
    SELECT coalesce(nullif(json_extract_string(labels, '$.path'), ''), '(unknown)') AS path,
      json_extract_string(labels, '$.status') AS status, greatest(0, arg_max(value, ts_us) - arg_min(value, ts_us)) AS d
    FROM hot_points WHERE name = 'http_requests_total' AND isfinite(value) GROUP BY labels) GROUP BY 1)
WHERE c4xx + c5xx > 0""",
    # What ingest must produce, written from the numbers and not by parsing.
    "expected_lines": """
SELECT scrape_id, target, scrape_ts, seq, http_status, body, line_no, family, kind, name,
  CAST(CASE line_no WHEN 3 THEN event_id WHEN 4 THEN event_id % 7 WHEN 6 THEN event_id % 11 WHEN 7 THEN event_id % 11 + 1
    WHEN 8 THEN event_id % 11 + 2 WHEN 9 THEN floor(value) WHEN 10 THEN event_id % 11 + 2 WHEN 12 THEN value
    WHEN 13 THEN 1000 WHEN 15 THEN user_id ELSE 1 END AS DOUBLE) AS value,
  replace(CASE line_no WHEN 3 THEN '{"method":"GET","path":"/a,b",@T,"status":"200"}'
    WHEN 4 THEN '{"path":"/say \\"hi\\"",@T,"status":"500"}' WHEN 6 THEN '{"le":"25",@T}' WHEN 7 THEN '{"le":"100",@T}'
    WHEN 8 THEN '{"le":"+Inf",@T}' WHEN 12 THEN '{"quantile":"0.5",@T}' WHEN 13 THEN '{"quantile":"0.99",@T}'
    WHEN 15 THEN '{"region":"DE",@T}' WHEN 16 THEN '{@T,"target":"x"}' ELSE '{@T}' END,
    '@T', concat('"scrape_target":"', target, '"')) AS labels
FROM (SELECT p.*, e.event_id, e.value, e.user_id FROM scrape_payloads p JOIN events e ON p.seq = e.event_id * 100)
CROSS JOIN (VALUES (3, 'http_requests_total', 'counter', 'http_requests_total'),
  (4, 'http_requests_total', 'counter', 'http_requests_total'),
  (6, 'http_request_duration_ms', 'histogram', 'http_request_duration_ms_bucket'),
  (7, 'http_request_duration_ms', 'histogram', 'http_request_duration_ms_bucket'),
  (8, 'http_request_duration_ms', 'histogram', 'http_request_duration_ms_bucket'),
  (9, 'http_request_duration_ms_sum', NULL, 'http_request_duration_ms_sum'),
  (10, 'http_request_duration_ms_count', NULL, 'http_request_duration_ms_count'),
  (12, 'http_rpc_ms', 'summary', 'http_rpc_ms'), (13, 'http_rpc_ms', 'summary', 'http_rpc_ms'),
  (15, 'unique_visitors_estimate', 'gauge', 'unique_visitors_estimate'),
  (16, 'collector_scrape_total', NULL, 'collector_scrape_total'), (17, 'something_else', NULL, 'something_else')
) AS l(line_no, family, kind, name)""",
    "target_prefixes": """
SELECT name AS target, unnest(CASE WHEN allow_csv = '' THEN ['http_', 'visitors_', 'unique_']
  ELSE string_split(allow_csv, ',') END) AS prefix FROM config_targets""",
    "accepted_lines": """
SELECT l.*, row_number() OVER (PARTITION BY scrape_id ORDER BY line_no) AS rank FROM expected_lines l
WHERE family NOT LIKE 'collector\\_%' ESCAPE '\\'
  AND EXISTS (SELECT 1 FROM target_prefixes p WHERE p.target = l.target AND starts_with(l.family, p.prefix))""",
    "payload_status": """
SELECT scrape_id, target, scrape_ts, seq,
  CASE WHEN http_status NOT BETWEEN 200 AND 299 THEN 'http_status' WHEN strlen(body) > 2000 THEN 'too_large' END AS fetch_reason
FROM scrape_payloads""",
    "overrides": """
SELECT id, arg_max(op = 'enable', seq) FILTER (WHERE op <> 'remove') AS enabled,
  coalesce(max(seq) FILTER (WHERE op = 'remove'), -1) > coalesce(max(seq) FILTER (WHERE op <> 'remove'), -1) AS removed
FROM override_log GROUP BY 1""",
    "registry": """
SELECT id, name, url, allow_csv, mode, origin, enabled FROM (
  SELECT *, row_number() OVER (PARTITION BY origin, trim(url) ORDER BY id) AS nth_url FROM (
    SELECT *, row_number() OVER (PARTITION BY origin, trim(name) ORDER BY id) AS nth_name FROM listed
    WHERE origin = 'config' OR trim(name) NOT IN (SELECT trim(name) FROM listed WHERE origin = 'config')
      AND trim(url) NOT IN (SELECT trim(url) FROM listed WHERE origin = 'config'))
  WHERE origin = 'config' OR nth_name = 1)
WHERE origin = 'config' OR nth_url = 1""",
    "listed": """
SELECT c.id, c.name, c.url, c.allow_csv, c.mode, 'config' AS origin, coalesce(o.enabled, c.enabled) AS enabled
FROM config_targets c LEFT JOIN overrides o USING (id) WHERE NOT coalesce(o.removed, false)
UNION ALL SELECT id, name, url, allow_csv, mode, 'dynamic', enabled FROM dynamic_targets""",
    "status_rows": """
SELECT t.name AS target, t.mode, t.enabled, a.last_status, a.last_ts, coalesce(a.last_samples, 0) AS last_samples,
  coalesce(a.last_duration_ms, 0) AS last_duration_ms, coalesce(a.streak, 0) AS consecutive_failures,
  coalesce(a.ok, 0) AS ok, coalesce(a.fetch_error, 0) AS fetch_error, coalesce(a.parse_error, 0) AS parse_error,
  CAST(0 AS BIGINT) AS other
FROM config_targets t LEFT JOIN (
  SELECT o.target, arg_max(status, attempt_seq) AS last_status, arg_max(ts, attempt_seq) AS last_ts,
    arg_max(samples, attempt_seq) AS last_samples, arg_max(duration_ms, attempt_seq) AS last_duration_ms,
    count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'fetch_error') AS fetch_error,
    count(*) FILTER (WHERE status = 'parse_error') AS parse_error,
    count(*) FILTER (WHERE attempt_seq > coalesce(k.last_ok, -1)) AS streak
  FROM scrape_outcomes o LEFT JOIN (
    SELECT target, max(attempt_seq) AS last_ok FROM scrape_outcomes WHERE status = 'ok' GROUP BY 1) k USING (target)
  GROUP BY 1) a ON a.target = t.name""",
}


def oracle(sql: str) -> str:
    """Prepend the views a query mentions, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in ORACLE_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in ORACLE_VIEWS:
            if other != name and other in needed and re.search(rf"\b{other}\b", ORACLE_VIEWS[name]):
                place(other)
        order.append(name)

    for name in needed:
        place(name)
    ctes = ",\n".join(f"{name} AS ({ORACLE_VIEWS[name].strip()})" for name in order)
    own = sql.strip()
    if not ctes:
        return own
    return f"WITH {ctes},\n{own.removeprefix('WITH')}" if own.startswith("WITH ") else f"WITH {ctes}\n{own}"


class Inputs:
    """The views of one scale, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        for table in TABLES:
            if re.search(rf"\bFROM {table}\b", VIEWS[name]):
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(VIEWS[name])

    @property
    def payloads(self) -> DataFrame:
        """Landed scrapes. The test table is one small file, which one task would read and parse alone.

        With fewer files than cores its (narrow) rows are spread before the bodies are written out.
        """
        events, cores = self.table("events"), self.spark.sparkContext.defaultParallelism
        if len(events.inputFiles()) < cores:
            events = events.repartition(cores, "event_id")
        events.createOrReplaceTempView("events")
        return self.spark.sql(VIEWS["scrape_payloads"])

    def spread_payloads(self, parts: int) -> DataFrame:
        """The same in so many parts, each of rows from all over the table: they move before their bodies are written out."""
        self.table("events").repartition(parts, "event_id").createOrReplaceTempView("events")
        return self.spark.sql(VIEWS["scrape_payloads"])

    @property
    def metrics(self) -> DataFrame:
        return self.view("metrics_all")

    @property
    def hot(self) -> DataFrame:
        return self.view("hot_samples")

    @property
    def keyed(self) -> DataFrame:
        """Recent samples the way ingest stores them: labels in order, and their identity as a column."""
        return self.hot.withColumn("series_key", F.concat("name", "labels"))

    def targets(self, name: str = "config_targets") -> DataFrame:
        return self.view(name).withColumn("allow", F.split("allow_csv", ",")).drop("allow_csv")

    @property
    def as_of(self) -> dt.datetime:
        """One second past the last event, on a whole second."""
        last = self.table("events").agg(F.unix_seconds(F.max("ts").cast("timestamp"))).first()[0]
        return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=last + 1)


Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
