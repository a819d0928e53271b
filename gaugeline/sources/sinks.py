"""Writing samples and rendering results for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import is_malformed, labels_json, labels_map, sorted_pairs
from ..functions.scalars import micros, prom_float
from ..operators.latest import latest_by_labels

# Fixed value: the warning a partial answer carries.
CLAMPED = "start predates the in-memory buffer; answer covers buffered data only"


def append_both(samples: DataFrame, history_path: str, recent_path: str, batch_id: int) -> None:
    """Write one batch to history and to the recent table.

    A batch owns its folder in both places, so a repeated batch replaces itself. The batch is
    written to history first and read back for the recent table: computed once, and both hold
    the same rows even if an executor was lost in between.
    """
    history = f"{history_path}/batch={batch_id}"
    samples.write.mode("overwrite").option("compression", "zstd").parquet(history)
    samples.sparkSession.read.parquet(history).write.mode("overwrite").parquet(f"{recent_path}/batch={batch_id}")


def matrix(points: DataFrame) -> DataFrame:
    """One row per series: the metric map and its points in time order.

    A validated range query bounds the points of a series (one per step, at most seven days).
    """
    point = F.struct((F.col("ts_us") / F.lit(1e6)).alias("t"), prom_float("value").alias("v"))
    rows = points.select("series_key", "name", "labels", point.alias("p"))
    grouped = rows.groupBy("series_key", "name", "labels").agg(F.array_sort(F.collect_list("p")).alias("values"))
    metric = F.map_concat(F.create_map(F.lit("__name__"), F.col("name")), labels_map())
    return grouped.select("series_key", metric.alias("metric"), "values")


def matrix_json(points: DataFrame, clamped: bool = False) -> DataFrame:
    """One JSON object per series, in the form of a range-query response entry."""
    pair = F.transform("values", lambda p: F.concat(F.lit("["), p["t"].cast("decimal(20,6)").cast("string"), F.lit(',"'), p["v"], F.lit('"]')))
    body = F.concat(
        F.lit('{"metric":'), labels_json(F.col("metric")), F.lit(',"values":['), F.array_join(pair, ","), F.lit("]}")
    )
    return matrix(points).select("series_key", body.alias("entry"), F.lit(clamped).alias("clamped"))


def response_json(points: DataFrame, clamped: bool = False, max_series: int = 10_000) -> str:
    """The whole response as one text, for an answer under the point cap."""
    entries = [r["entry"] for r in matrix_json(points).orderBy("series_key").limit(max_series + 1).collect()]
    if len(entries) > max_series:
        raise ValueError("answer too large for one document; write matrix_json() as a table instead")
    warning = f',"warnings":["{CLAMPED}"]' if clamped else ""
    return f'{{"status":"success","data":{{"resultType":"matrix","result":[{",".join(entries)}]}}{warning}}}'


def prom_text(samples: DataFrame) -> DataFrame:
    """Latest value of every series as one exposition line, ready for ``write.text``."""
    newest = latest_by_labels(samples.withColumn("ts_us", micros("ts")), ["name"])

    def escaped(text):
        for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            text = F.replace(text, F.lit(raw), F.lit(written))
        return text

    pairs = F.transform(
        sorted_pairs(labels_map()), lambda p: F.concat(p["key"], F.lit('="'), escaped(p["value"]), F.lit('"'))
    )
    # Labels that could not be read are shown as they are, under a name of their own.
    unread = F.concat(F.lit('{__unread__="'), escaped(F.col("labels")), F.lit('"}'))
    braces = (
        F.when(is_malformed(), unread)
        .when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    )
    return newest.select(F.concat("name", braces, F.lit(" "), prom_float("value")).alias("value"))
