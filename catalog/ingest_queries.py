"""Ingest, targets, health and jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gaugeline.functions.labels import labels_json
from gaugeline.functions.scalars import moment
from gaugeline.operators import exposition as X, health, ingest as I, targets as T
from gaugeline.sources.metrics import is_export_name
from gaugeline.sources.payloads import classify_payloads

from .base import Inputs, query

_CONFIG = I.IngestConfig(max_samples=8, max_body_bytes=2000)
_SAMPLE_COLUMNS = ["scrape_id", "target", "ts", "name", "metric_type", "value", "labels", "line_no"]


def _parsed(c: Inputs):
    return X.parse_exposition(c.payloads)


def _with_target(df):
    return df.withColumn("labels", labels_json(X.inject_target(F.col("labels"), F.col("target"))))


def _stage(c: Inputs, config=_CONFIG):
    return I.staged(c.payloads, c.targets(), config)


@query("scrape_payload_source", "SELECT scrape_id, fetch_reason, CASE WHEN fetch_reason IS NULL THEN 'ok' ELSE 'fetch_error' END AS status FROM payload_status")
def _(c: Inputs):
    return classify_payloads(c.payloads, 2000).select("scrape_id", "fetch_reason", "status")


@query("exposition_parse", "SELECT scrape_id, line_no, name, value FROM expected_lines")
def _(c: Inputs):
    return _parsed(c).select("scrape_id", "line_no", "name", "value")


@query("exposition_types", """SELECT scrape_id, line_no, family, kind, CASE WHEN kind = 'gauge' THEN 'gauge' ELSE 'counter' END AS metric_type
FROM expected_lines""")
def _(c: Inputs):
    return _parsed(c).select("scrape_id", "line_no", "family", "kind", X.metric_type().alias("metric_type"))


@query("histogram_decompose", "SELECT scrape_id, line_no, name, labels, value FROM expected_lines WHERE kind = 'histogram'")
def _(c: Inputs):
    out = X.decompose_histograms(_parsed(c).filter("kind = 'histogram'"))
    return _with_target(out).select("scrape_id", "line_no", "name", "labels", "value")


@query("summary_decompose", "SELECT scrape_id, line_no, name, labels, value FROM expected_lines WHERE kind = 'summary'")
def _(c: Inputs):
    out = X.decompose_summaries(_parsed(c).filter("kind = 'summary'"))
    return _with_target(out).select("scrape_id", "line_no", "name", "labels", "value")


@query("label_inject", "SELECT scrape_id, line_no, labels FROM expected_lines")
def _(c: Inputs):
    whole = X.decompose_summaries(X.decompose_histograms(_parsed(c)))
    return _with_target(whole).select("scrape_id", "line_no", "labels")


@query("deny_filter", "SELECT scrape_id, line_no, family FROM expected_lines WHERE family <> 'something_else' AND NOT starts_with(family, 'collector_')")
def _(c: Inputs):
    config = I.IngestConfig(deny_prefixes=("collector_", "something_else"))
    return _parsed(c).filter(~I.denied(F.col("family"), config)).select("scrape_id", "line_no", "family")


@query("allowlist_semi_join", """SELECT scrape_id, line_no, family FROM expected_lines l
WHERE EXISTS (SELECT 1 FROM target_prefixes p WHERE p.target = l.target AND starts_with(l.family, p.prefix))""")
def _(c: Inputs):
    return I.allowlist_semi_join(_parsed(c), c.targets()).select("scrape_id", "line_no", "family")


@query("scrape_cap", "SELECT scrape_id, line_no FROM accepted_lines WHERE rank <= 4")
def _(c: Inputs):
    rows = I.allowlist_semi_join(_parsed(c), c.targets())
    return I.cap_samples(rows.filter(~I.denied(F.col("family"))), 4)[0].select("scrape_id", "line_no")


@query("scrape_cap_counts", "SELECT scrape_id, least(count(*), 8) AS kept, greatest(count(*) - 8, 0) AS dropped FROM accepted_lines GROUP BY 1")
def _(c: Inputs):
    rows = I.allowlist_semi_join(_parsed(c), c.targets())
    return I.cap_samples(rows.filter(~I.denied(F.col("family"))), 8)[1]


@query("cap_rank", "SELECT scrape_id, line_no, row_number() OVER (PARTITION BY scrape_id ORDER BY line_no) AS rank FROM expected_lines")
def _(c: Inputs):
    return I.cap_rank(_parsed(c)).select("scrape_id", "line_no", "rank")


_OUTCOMES = """SELECT s.scrape_id, s.target, CASE WHEN reason IS NULL THEN 'ok' ELSE 'fetch_error' END AS status, reason AS fetch_reason,
  CASE WHEN reason IS NULL THEN least(coalesce(n, 0), 8) ELSE 0 END AS samples,
  CASE WHEN reason IS NULL THEN greatest(coalesce(n, 0) - 8, 0) ELSE 0 END AS dropped
FROM (SELECT *, coalesce(fetch_reason, CASE WHEN target NOT IN (SELECT name FROM config_targets) THEN 'unknown_target' END) AS reason
  FROM payload_status) s
LEFT JOIN (SELECT scrape_id, count(*) AS n FROM accepted_lines GROUP BY 1) a ON a.scrape_id = s.scrape_id"""


@query("outcome_classify", _OUTCOMES)
def _(c: Inputs):
    return I.outcomes_from(_stage(c), _CONFIG).select("scrape_id", "target", "status", "fetch_reason", "samples", "dropped")


_BAD_LINES = ("c{garbage} 7", 'x_bucket{le="1"} 5 # {trace_id="a"} 0.6', 'http_requests_total{path="/a" abc', "http_requests_total abc", " \t")


@query("outcome_lines", """SELECT scrape_id, status, lines, blank, comments, 12 * ok AS samples, 5 * ok AS unread, ok AS unread_exemplar, 2 * ok AS unread_labels, ok AS unread_value,
  ok AS unread_line FROM (
  SELECT scrape_id, CASE WHEN fetch_reason IS NULL THEN 'ok' ELSE 'fetch_error' END AS status, CASE WHEN fetch_reason IS NULL THEN 1 END AS ok,
    CASE WHEN fetch_reason IS NULL THEN len(string_split(body, chr(10))) + 5 END AS lines,
    CASE WHEN fetch_reason IS NULL THEN len(list_filter(string_split(body, chr(10)), lambda x: x = '')) + 1 END AS blank,
    CASE WHEN fetch_reason IS NULL THEN len(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '#'))) END AS comments
  FROM payload_status JOIN scrape_payloads USING (scrape_id))""")
def _(c: Inputs):
    """Every line of a body is blank, a comment, a sample or unread for a reason; five lines are added to each, four of them bad."""
    added = F.lit("".join(f"\n{line}" for line in _BAD_LINES))
    payloads = c.payloads.withColumn("body", F.concat("body", added))
    config = replace(_CONFIG, count_lines=True, max_body_bytes=_CONFIG.max_body_bytes + sum(len(line) + 1 for line in _BAD_LINES))
    return I.outcomes_from(I.staged(payloads, c.targets(), config), config).select("scrape_id", "status", "text.*")


@query("self_metrics", f"""SELECT t AS ts, name, value, 'counter' AS metric_type, labels FROM as_of, (
  SELECT 'collector_scrape_total' AS name, CAST(count(*) AS DOUBLE) AS value,
    concat('{{"status":"', status, '","target":"', target, '"}}') AS labels FROM ({_OUTCOMES}) GROUP BY status, target
  UNION ALL SELECT 'collector_samples_stored_total', CAST(sum(samples) AS DOUBLE), concat('{{"target":"', target, '"}}')
  FROM ({_OUTCOMES}) WHERE status = 'ok' GROUP BY target
  UNION ALL SELECT 'collector_samples_dropped_total', CAST(sum(dropped) AS DOUBLE), concat('{{"reason":"over_cap","target":"', target, '"}}')
  FROM ({_OUTCOMES}) WHERE dropped > 0 GROUP BY target)""")
def _(c: Inputs):
    return I.self_metrics(I.outcomes_from(_stage(c), _CONFIG), moment(c.as_of))


_INGESTED = """SELECT l.scrape_id, l.target, l.scrape_ts AS ts, l.name, CASE WHEN kind = 'gauge' THEN 'gauge' ELSE 'counter' END AS metric_type,
  l.value, l.labels, l.line_no FROM accepted_lines l JOIN payload_status s USING (scrape_id) WHERE s.fetch_reason IS NULL AND rank <= {cap}"""


@query("ingest_samples", _INGESTED.format(cap=8))
def _(c: Inputs):
    return I.samples_from(_stage(c), _CONFIG).select(*_SAMPLE_COLUMNS)


@query("ingest_promoted", f"""SELECT json_extract_string(labels, '$.path') AS path, json_extract_string(labels, '$.status') AS status,
  json_extract_string(labels, '$.scrape_target') AS scrape_target, json_extract_string(labels, '$.region') AS region, count(*) AS n
FROM ({_INGESTED.format(cap=5000)}) GROUP BY 1, 2, 3, 4""")
def _(c: Inputs):
    config = I.IngestConfig(max_body_bytes=2000)
    rows = I.ingest(c.payloads, c.targets(), config)[0]
    return rows.groupBy("path", "status", "scrape_target", "region").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_registry", f"""SELECT scrape_id, target, name, value, labels, line_no FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.scrape_id ORDER BY l.line_no) AS place FROM expected_lines l
  JOIN payload_status s USING (scrape_id) WHERE s.fetch_reason IS NULL AND l.family NOT LIKE 'collector\\_%' ESCAPE '\\'
    AND EXISTS (SELECT 1 FROM registry r, (SELECT unnest(CASE WHEN r.allow_csv = '' THEN ['http_', 'visitors_', 'unique_']
      ELSE string_split(r.allow_csv, ',') END) AS prefix) WHERE r.name = l.target AND starts_with(l.family, prefix))) WHERE place <= 8""")
def _(c: Inputs):
    """Ingest over declared and added targets together, with each row of the registry given twice."""
    known = _registry(c)
    stage = I.staged(c.payloads, known.unionByName(known), _CONFIG)
    return I.samples_from(stage, _CONFIG).select("scrape_id", "target", "name", "value", "labels", "line_no")


# Targets.

_COLUMNS = ["id", "name", "url", "mode", "origin", "enabled"]


def _registry(c: Inputs):
    return T.effective_targets(c.targets(), c.targets("dynamic_targets"), c.view("override_log"))


@query("effective_targets", f"SELECT {', '.join(_COLUMNS)} FROM registry")
def _(c: Inputs):
    return _registry(c).select(*_COLUMNS)


@query("effective_targets_chained", """WITH RECURSIVE ordered AS (
  SELECT id, name, url, row_number() OVER (ORDER BY id) AS n, k FROM (
    SELECT concat('t', c_custkey) AS id, concat('n', c_custkey // 64, '_', c_custkey % 64 // 2) AS name,
      concat('http://u', c_custkey // 64, '_', (c_custkey % 64 + 1) // 2) AS url, c_custkey // 64 AS k FROM customer)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM ordered),
steps AS (
  SELECT k, 0 AS i, ['']::VARCHAR[] AS names, ['']::VARCHAR[] AS urls, NULL::VARCHAR AS id FROM (SELECT DISTINCT k FROM numbered)
  UNION ALL SELECT s.k, s.i + 1,
    CASE WHEN list_contains(s.names, o.name) OR list_contains(s.urls, o.url) THEN s.names ELSE list_append(s.names, o.name) END,
    CASE WHEN list_contains(s.names, o.name) OR list_contains(s.urls, o.url) THEN s.urls ELSE list_append(s.urls, o.url) END,
    CASE WHEN list_contains(s.names, o.name) OR list_contains(s.urls, o.url) THEN NULL ELSE o.id END
  FROM steps s JOIN numbered o ON o.k = s.k AND o.i = s.i + 1)
SELECT id FROM steps WHERE id IS NOT NULL""")
def _(c: Inputs):
    """Added targets in chains of 64, each sharing its name with one neighbour and its address with the other."""
    key = F.col("c_custkey")
    block, place = F.floor(key / 64), F.pmod(key, F.lit(64))
    rows = c.table("customer").select(
        F.concat(F.lit("t"), key).alias("id"), F.concat(F.lit("n"), block, F.lit("_"), F.floor(place / 2)).alias("name"),
        F.concat(F.lit("http://u"), block, F.lit("_"), F.floor((place + 1) / 2)).alias("url"), F.lit(1).alias("ord"), F.lit("dynamic").alias("origin"))
    return T.resolve_conflicts(rows).select("id")


@query("recurring_enabled", "SELECT id, name FROM registry WHERE enabled AND mode = 'recurring'")
def _(c: Inputs):
    return T.recurring_enabled(_registry(c)).select("id", "name")


@query("override_left_join", "SELECT c.id, coalesce(o.enabled, c.enabled) AS enabled FROM config_targets c LEFT JOIN overrides o USING (id)")
def _(c: Inputs):
    declared = c.targets().withColumn("origin", F.lit("config"))
    return T.apply_overrides(declared, T.fold_overrides(c.view("override_log"))).select("id", "enabled")


@query("tombstone_anti_join", "SELECT id, name FROM config_targets WHERE id NOT IN (SELECT id FROM overrides WHERE removed)")
def _(c: Inputs):
    return T.drop_removed(c.targets(), T.fold_overrides(c.view("override_log"))).select("id", "name")


@query("union_targets", """SELECT 0 AS ord, id, name, 'config' AS origin FROM config_targets
UNION ALL SELECT 1, id, name, 'dynamic' FROM dynamic_targets""")
def _(c: Inputs):
    return T.union_targets(c.targets(), c.targets("dynamic_targets")).select("ord", "id", "name", "origin")


@query("default_allow", "SELECT target, string_agg(prefix, ',' ORDER BY prefix) AS allow FROM target_prefixes GROUP BY 1")
def _(c: Inputs):
    rows = T.with_default_allow(c.targets())
    return rows.select(F.col("name").alias("target"), F.array_join(F.array_sort("allow"), ",").alias("allow"))


_ALL = """SELECT id, name, url, 'config' AS origin FROM config_targets UNION ALL SELECT id, name, url, 'dynamic' FROM dynamic_targets"""


@query("target_quality_checks", f"""
SELECT CASE WHEN c > 0 AND d > 0 THEN 'name_conflicts_with_config' ELSE 'duplicate_name' END AS reason, subject, n FROM (
  SELECT trim(name) AS subject, count(*) AS n, count(*) FILTER (WHERE origin = 'config') AS c, count(*) FILTER (WHERE origin = 'dynamic') AS d
  FROM ({_ALL}) GROUP BY 1) WHERE n > 1
UNION ALL SELECT CASE WHEN c > 0 AND d > 0 THEN 'url_conflicts_with_config' ELSE 'duplicate_url' END, subject, n FROM (
  SELECT trim(url) AS subject, count(*) AS n, count(*) FILTER (WHERE origin = 'config') AS c, count(*) FILTER (WHERE origin = 'dynamic') AS d
  FROM ({_ALL}) GROUP BY 1) WHERE n > 1
UNION ALL SELECT 'blank_name', id, 1 FROM ({_ALL}) WHERE trim(name) = ''
UNION ALL SELECT 'bad_url', url, count(*) FROM ({_ALL})
  WHERE NOT (starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://')) OR contains(trim(url), ' ') GROUP BY 2
UNION ALL SELECT 'too_many_dynamic', 'dynamic', n FROM (SELECT count(*) AS n FROM dynamic_targets) WHERE n > 64""")
def _(c: Inputs):
    return T.quality_checks(T.union_targets(c.targets(), c.targets("dynamic_targets")))


# Health and jobs.

@query("target_status", "SELECT * FROM status_rows")
def _(c: Inputs):
    status = health.target_status(c.view("scrape_outcomes"), c.targets())
    return status.select(
        "target", "mode", "enabled", "last_status", "last_ts", "last_samples", "last_duration_ms", "consecutive_failures",
        "ok", "fetch_error", "parse_error", "other",
    )


@query("outcome_target_join", "SELECT target, mode, last_status IS NOT NULL AS scraped FROM status_rows")
def _(c: Inputs):
    status = health.target_status(c.view("scrape_outcomes"), c.targets())
    return status.select("target", "mode", F.col("last_status").isNotNull().alias("scraped"))


@query("collector_health", """SELECT CASE WHEN bool_or(consecutive_failures > 0) THEN 'degraded'
  WHEN bool_or(enabled AND mode = 'recurring' AND last_ts IS NULL) THEN 'starting' ELSE 'ok' END AS status, count(*) AS targets FROM status_rows""")
def _(c: Inputs):
    return health.collector_health(health.target_status(c.view("scrape_outcomes"), c.targets()))


@query("health_snapshot", """SELECT h.*, s.*, j.* FROM (SELECT CASE WHEN bool_or(consecutive_failures > 0) THEN 'degraded'
  WHEN bool_or(enabled AND mode = 'recurring' AND last_ts IS NULL) THEN 'starting' ELSE 'ok' END AS status, count(*) AS targets FROM status_rows) h,
  (SELECT epoch_us(arg_min(ts, seq)) AS oldest_us, epoch_us(arg_max(ts, seq)) AS newest_us, count(*) AS samples, CAST(20000 AS BIGINT) AS capacity FROM hot_samples) s,
  (SELECT count(*) FILTER (WHERE state = 'pending') AS depth, count(*) FILTER (WHERE state = 'running') AS running,
    count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'failed') AS failed FROM scrape_jobs) j""")
def _(c: Inputs):
    status = health.target_status(c.view("scrape_outcomes"), c.targets())
    return health.snapshot(status, c.hot, c.view("scrape_jobs"))


@query("failure_streak", """SELECT o.target, count(*) FILTER (WHERE attempt_seq > coalesce(k.last_ok, -1)) AS consecutive_failures
FROM scrape_outcomes o LEFT JOIN (SELECT target, max(attempt_seq) AS last_ok FROM scrape_outcomes WHERE status = 'ok' GROUP BY 1) k USING (target)
GROUP BY 1""")
def _(c: Inputs):
    return health.failure_streak(c.view("scrape_outcomes"))


@query("job_summary", """SELECT count(*) FILTER (WHERE state = 'pending') AS depth, 256 AS cap, false AS paused, true AS frozen,
  count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'done') AS done,
  count(*) FILTER (WHERE state = 'failed') AS failed FROM scrape_jobs""")
def _(c: Inputs):
    return health.job_summary(c.view("scrape_jobs"), frozen=True)


@query("recent_jobs", """SELECT job_id, target, kind, state, finished_at FROM scrape_jobs WHERE state IN ('done', 'failed', 'cancelled')
ORDER BY finished_at DESC, job_id DESC LIMIT 100""")
def _(c: Inputs):
    return health.recent_jobs(c.view("scrape_jobs")).select("job_id", "target", "kind", "state", "finished_at")


@query("is_export_name", """SELECT event_id, event_id % 4 = 0 OR event_id % 4 = 3 AND false AS ok FROM events""")
def _(c: Inputs):
    kinds = F.element_at(
        F.array(F.lit(".parquet"), F.lit(".part"), F.lit("/../x.parquet"), F.lit("..parquet")), (F.col("event_id") % 4 + 1).cast("int")
    )
    return c.table("events").select("event_id", is_export_name(F.concat(F.lit("metrics_cold_"), F.col("event_id").cast("string"), kinds)).alias("ok"))
