"""Exposition text to samples, on small literal bodies."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gaugeline.functions.labels import labels_json
from gaugeline.operators import exposition as X, ingest as I
from gaugeline.sources.payloads import classify_payloads

BODY = '''# HELP a n
# TYPE http_requests_total counter
http_requests_total{status="200",path="/a,b}",method="GET"} 5
http_requests_total{path="say \\"hi\\" \\\\n x\\n"} 1e3 1700000000
dup{a="1",a="2"} 1
# TYPE h histogram
h_bucket{le="25.0"} 3
h_bucket{le="+Inf"} 4
h_sum 3.5
h_count 4
# TYPE q summary
q{quantile="0.50"} NaN
# TYPE g gauge
g -Inf
garbage
g{x="1} 3
u 0x1p-2
u 1d
u .5
# TYPE g counter
g 7'''


def payloads(spark, *rows):
    schema = "scrape_id string, target string, scrape_ts timestamp_ntz, seq bigint, http_status int, body string"
    import datetime as dt

    now = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t, now, n * 100_000, s, b) for n, (i, t, s, b) in enumerate(rows)], schema)


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, allow array<string>")


@pytest.fixture(scope="module")
def parsed(spark):
    rows = X.parse_exposition(payloads(spark, ("s", "app", 200, BODY)))
    rows = X.decompose_summaries(X.decompose_histograms(rows)).withColumn("type", X.metric_type())
    return {r["line_no"]: r for r in rows.collect()}


def test_only_valid_sample_lines_survive(parsed):
    assert sorted(parsed) == [3, 4, 5, 7, 8, 9, 10, 12, 14, 19, 21]


def test_labels_with_commas_braces_and_escapes(parsed):
    assert parsed[3]["labels"] == {"status": "200", "path": "/a,b}", "method": "GET"}
    assert parsed[4]["labels"] == {"path": 'say "hi" \\n x\n'}
    assert parsed[4]["value"] == 1000.0


def test_a_repeated_label_keeps_its_last_value(parsed):
    assert parsed[5]["labels"] == {"a": "2"}


def test_histogram_buckets_keep_their_name_and_normalise_le(parsed):
    assert (parsed[7]["name"], parsed[7]["family"], parsed[7]["labels"]) == ("h_bucket", "h", {"le": "25"})
    assert parsed[8]["labels"] == {"le": "+Inf"}
    assert (parsed[9]["family"], parsed[9]["kind"], parsed[9]["type"]) == ("h_sum", None, "counter")


def test_summary_quantiles_keep_the_base_name(parsed):
    assert parsed[12]["name"] == "q" and parsed[12]["labels"] == {"quantile": "0.5"}
    assert math.isnan(parsed[12]["value"]) and parsed[12]["type"] == "counter"


def test_the_latest_type_line_above_a_sample_decides(parsed):
    assert (parsed[14]["kind"], parsed[14]["value"]) == ("gauge", -math.inf)
    assert parsed[21]["kind"] == "counter"


def test_untyped_samples_become_counters(parsed):
    assert parsed[19]["kind"] is None and parsed[19]["type"] == "counter" and parsed[19]["value"] == 0.5


def test_carriage_returns_are_harmless(spark):
    rows = X.parse_exposition(payloads(spark, ("s", "app", 200, '# TYPE a gauge\r\na{x="1"} 2\r\nb 3\r\n'))).collect()
    assert [(r["name"], r["kind"], r["value"]) for r in rows] == [("a", "gauge", 2.0), ("b", None, 3.0)]


def test_a_type_line_below_the_sample_does_not_count(spark):
    rows = X.parse_exposition(payloads(spark, ("s", "app", 200, "a 1\n# TYPE a gauge\na 2"))).collect()
    assert [r["kind"] for r in rows] == [None, "gauge"]


def test_the_scraped_target_label_is_replaced(spark):
    body = 'http_a{scrape_target="evil",z="1"} 1'
    rows = I.ingest(payloads(spark, ("s", "app", 200, body)), targets(spark, ("app", ["http_"])))[0].collect()
    assert [r["labels"] for r in rows] == ['{"scrape_target":"app","z":"1"}']


def test_deny_comes_before_allow_and_filtered_samples_are_not_dropped(spark):
    body = "collector_x 1\nengine_dropped_total 2\nengine_up 1\nhttp_a 1\nother 1"
    config = I.IngestConfig(own_namespaces=("engine",))
    samples, outcomes = I.ingest(
        payloads(spark, ("s", "app", 200, body)), targets(spark, ("app", ["collector_", "engine_", "http_"])), config
    )
    assert sorted(r["name"] for r in samples.collect()) == ["engine_up", "http_a"]
    row = outcomes.first()
    assert (row["samples"], row["dropped"]) == (2, 0)


def test_the_allowlist_judges_the_family_of_a_bucket(spark):
    body = '# TYPE http_ms histogram\nhttp_ms_bucket{le="1"} 1\nhttp_ms_sum 2'
    rows = I.ingest(payloads(spark, ("s", "app", 200, body)), targets(spark, ("app", ["http_ms_"])))[0].collect()
    assert [r["name"] for r in rows] == ["http_ms_sum"]


def test_default_prefixes_apply_to_an_empty_list(spark):
    body = "http_a 1\nvisitors_b 1\nunique_c 1\nqueue_depth 1"
    rows = I.ingest(payloads(spark, ("s", "app", 200, body)), targets(spark, ("app", [])))[0].collect()
    assert sorted(r["name"] for r in rows) == ["http_a", "unique_c", "visitors_b"]


def test_cap_keeps_the_first_and_counts_the_rest(spark):
    body = "\n".join(f"http_{i} {i}" for i in range(10))
    config = I.IngestConfig(max_samples=4)
    samples, outcomes = I.ingest(payloads(spark, ("s", "app", 200, body)), targets(spark, ("app", ["http_"])), config)
    assert [r["value"] for r in samples.orderBy("line_no").collect()] == [0, 1, 2, 3]
    assert outcomes.select("status", "samples", "dropped").first() == ("ok", 4, 6)
    rows = X.parse_exposition(payloads(spark, ("s", "app", 200, body)))
    kept, sizes = I.cap_samples(rows, 4)
    assert kept.count() == 4 and sizes.select("kept", "dropped").first() == (4, 6)


def test_payload_classes(spark):
    rows = payloads(spark, ("a", "t", 200, "x 1"), ("b", "t", 503, "x 1"), ("c", "t", 200, "y" * 50), ("d", "t", None, None), ("e", "t", 299, "é" * 20))
    found = {r["scrape_id"]: (r["status"], r["fetch_reason"]) for r in classify_payloads(rows, 40).collect()}
    assert found == {
        "a": ("ok", None), "b": ("fetch_error", "http_status"), "c": ("fetch_error", "too_large"),
        "d": ("fetch_error", "transport"), "e": ("ok", None),
    }
    binary = rows.limit(1).withColumn("body", F.unhex(F.lit("FF41")))
    assert classify_payloads(binary).first()["fetch_reason"] == "invalid_utf8"


def test_garbage_is_ok_with_no_samples_and_a_failed_scrape_stores_nothing(spark):
    rows = payloads(spark, ("a", "app", 200, "<html>"), ("b", "app", 500, "http_a 1"))
    samples, outcomes = I.ingest(rows, targets(spark, ("app", ["http_"])))
    assert samples.count() == 0
    assert {r["scrape_id"]: (r["status"], r["samples"]) for r in outcomes.collect()} == {"a": ("ok", 0), "b": ("fetch_error", 0)}


def test_a_long_label_block_does_not_overflow_the_matcher(spark):
    value = "x" * 200_000 + '\\"' * 1000
    rows = X.parse_exposition(payloads(spark, ("s", "app", 200, f'http_a{{k="{value}"}} 1'))).collect()
    assert len(rows[0]["labels"]["k"]) == 201_000


def test_labels_text_is_canonical(spark):
    row = spark.range(1).select(labels_json(F.create_map(F.lit("b"), F.lit('q"'), F.lit("a"), F.lit("1"))).alias("l")).first()
    assert row["l"] == '{"a":"1","b":"q\\""}'
