"""Landed scrape bodies as the source of ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: bytes a body may have.
MAX_BODY_BYTES = 1_048_576


def classify_payloads(payloads: DataFrame, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Add ``fetch_reason`` (null when the body is usable) and ``status`` ok or fetch_error.

    A transport failure is a row without status code or body. Bodies may be text or bytes.
    """
    body = F.col("body")
    text = F.try_validate_utf8(body.cast("string"))
    reason = (
        F.when(F.col("http_status").isNull() | body.isNull(), "transport")
        .when((F.col("http_status") < 200) | (F.col("http_status") > 299), "http_status")
        .when(F.octet_length(body) > max_bytes, "too_large")
        .when(text.isNull(), "invalid_utf8")
    )
    checked = payloads.withColumn("fetch_reason", reason)
    return checked.withColumn("status", F.when(F.col("fetch_reason").isNull(), "ok").otherwise("fetch_error"))
