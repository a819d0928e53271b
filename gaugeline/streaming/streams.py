"""Continuous forms of the batch operators.

Small state (the recent window, target status, rows held back) is a table per batch. Batch ``n`` reads the
table of batch ``n - 1`` and replaces its own, so a batch that is repeated after a failure finds its
input untouched; once it is written, the table of batch ``n - 2`` goes. A reader takes the newest
table that is complete, which stays until two more batches are done.

State with a row per series is a log of changes: a batch writes the series it touched, and the newest row of a
series counts. Every ``MERGE`` batches the changes so far are merged into one table, so a batch writes in proportion to
its own series, and a reader sees few folders.

No row leaves unseen: what an operator cannot use goes aside, whole, with the reason.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import series_key
from ..functions.scalars import micros
from ..operators.health import STATUSES, failure_streak, outcome_rollup
from ..operators.ingest import IngestConfig, outcomes_from, samples_from, staged
from ..operators.latest import arrival_order, latest
from ..operators.ring import keep_newest
from ..operators.series import MEASURED, counter_diffs
from ..operators.sketches import sketched
from ..session import checkpointed, file_system, small_side
from ..sources.sinks import append_both


def read_files(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """Stream of Parquet files with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


#: Run over what is there and stop. Any other trigger, as {"processingTime": "1 minute"}, keeps a stream running.
ONCE = {"availableNow": True}
#: Batches after which the changes to a state are merged.
MERGE = 32


def _each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict = ONCE
) -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(work).trigger(**trigger).start()


def _put(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _previous(spark: SparkSession, state: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{state}/{batch_id - 1}") if batch_id > 0 else None


def _keep(df: DataFrame, state: str, batch_id: int) -> None:
    _put(df, f"{state}/{batch_id}")
    system, old = file_system(df.sparkSession, f"{state}/{batch_id - 2}")
    system.delete(old, True)


def current_state(spark: SparkSession, state: str) -> DataFrame:
    """The newest complete table."""
    system, path = file_system(spark, f"{state}/*/_SUCCESS")
    done = [int(found.getPath().getParent().getName()) for found in system.globStatus(path) or ()]
    if not done:
        raise FileNotFoundError(f"no batch has finished in {state}")
    return spark.read.parquet(f"{state}/{max(done)}")


def _finished(spark: SparkSession, state: str, kind: str) -> list[int]:
    """Batches whose ``kind`` of folder is complete."""
    system, path = file_system(spark, f"{state}/{kind}-*/_SUCCESS")
    return sorted(int(found.getPath().getParent().getName().rsplit("-", 1)[1]) for found in system.globStatus(path) or ())


def _changes(spark: SparkSession, state: str, before: float = float("inf")) -> DataFrame | None:
    """The rows of all batches below a number: those merged, and the changes since."""
    merged = max((b for b in _finished(spark, state, "merged") if b < before), default=None)
    since = [f"{state}/batch-{b}" for b in _finished(spark, state, "batch") if (merged is None or b > merged) and b < before]
    paths = [f"{state}/merged-{merged}"] * (merged is not None) + since
    return spark.read.parquet(*paths) if paths else None


def _merge(spark: SparkSession, state: str, batch_id: int, newest: Callable[[DataFrame], DataFrame], every: int) -> None:
    """Before every so many batches, merge the changes of the earlier ones, and drop what the merge before covered."""
    if not batch_id or batch_id % every:
        return
    covered = max((b for b in _finished(spark, state, "merged") if b < batch_id - 1), default=None)
    if batch_id - 1 not in _finished(spark, state, "merged"):
        _put(newest(_changes(spark, state, batch_id)), f"{state}/merged-{batch_id - 1}")
    if covered is not None:
        old = [f"merged-{b}" for b in _finished(spark, state, "merged") if b < covered]
        for name in [*old, *(f"batch-{b}" for b in _finished(spark, state, "batch") if b <= covered)]:
            system, path = file_system(spark, f"{state}/{name}")
            system.delete(path, True)


def stream_ingest(
    payloads: DataFrame, targets: DataFrame, out: str, checkpoint: str, config: IngestConfig = IngestConfig(), trigger: dict = ONCE
) -> StreamingQuery:
    """Payload files to ``samples`` and ``outcomes`` folders; a batch owns its folder and replaces it."""
    held = checkpointed(targets)

    def work(batch: DataFrame, batch_id: int) -> None:
        stage = staged(batch, held, config).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _put(samples_from(stage, config), f"{out}/samples/batch={batch_id}")
            _put(outcomes_from(stage, config), f"{out}/outcomes/batch={batch_id}")
        finally:
            stage.unpersist()

    return _each_batch(payloads, work, checkpoint, trigger=trigger)


def append_batch(history: str, recent: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: append_both(batch, history, recent, batch_id)


def stream_append(samples: DataFrame, history: str, recent: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Samples into history and the recent table together; a batch that is repeated replaces its folder in both."""
    return _each_batch(samples, append_batch(history, recent), checkpoint, trigger=trigger)


def split_batch(out: str, time: str, delay_us: int, width_us: int | None = None) -> Callable[[DataFrame, int], None]:
    """Write a batch as ``ontime`` and ``late`` rows; see :func:`stream_split`."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _previous(spark, f"{out}/clock", batch_id)
        top = before.first()["top_us"] if before is not None else None
        moment = F.col(time).cast("timestamp")
        close = F.unix_micros(moment)
        if width_us is not None:  # the end of its window; windows are counted from the epoch
            close = close - F.pmod(close, F.lit(width_us).cast("long")) + width_us
        reason = F.when(F.col(time).isNull(), "no_time")
        if top is not None:
            reason = reason.when(close <= F.lit(top - delay_us), "late")
        rows = batch.withColumn("_reason", reason).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _put(rows.filter("_reason IS NULL").drop("_reason"), f"{out}/ontime/batch={batch_id}")
            _put(rows.filter("_reason IS NOT NULL").withColumnRenamed("_reason", "reason"), f"{out}/late/batch={batch_id}")
            clock = rows.agg(F.greatest(F.lit(top).cast("long"), F.unix_micros(F.max(moment))).alias("top_us"))
            _keep(clock, f"{out}/clock", batch_id)
        finally:
            rows.unpersist()

    return work


def stream_split(
    stream: DataFrame, out: str, checkpoint: str, time: str = "ts", delay_us: int = 3_600_000_000, width_us: int | None = None, trigger: dict = ONCE,
) -> StreamingQuery:
    """Divide a stream into ``ontime/batch=<n>``, which a watermark of this delay drops nothing of, and ``late/batch=<n>``.

    A row is late if its time (with ``width_us``, the end of its window) is not after the newest time of all earlier batches
    less the delay: that is when Spark takes it for late at the earliest, if it reads the batches of ``ontime`` in their
    order. The newest time is carried in a table, so it holds across restarts and however many batches there are. Late rows,
    and rows without a time, keep all their columns and have a ``reason``. Every row is in one of the two.
    """
    return _each_batch(stream, split_batch(out, time, delay_us, width_us), checkpoint, trigger=trigger)


def read_ontime(spark: SparkSession, out: str, like: DataFrame, per_trigger: int = 1000) -> DataFrame:
    """Stream of what :func:`stream_split` found in time, in its order."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{out}/ontime/*")


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that came too late for a watermark, over the progress Spark still holds of a query."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def stream_throughput(
    metrics: DataFrame, out: str, checkpoint: str, width: str = "1 hour", delay: str = "1 hour", approx_p99: bool = False,
    sketch_k: int | None = None, trigger: dict = ONCE,
) -> StreamingQuery:
    """Request rows and mean duration per tumbling window, each window written once it is closed.

    ``approx_p99`` adds an estimate of the 99th percentile, ``sketch_k`` a mergeable sketch ``ms_sketch`` of that size
    (see :mod:`gaugeline.operators.sketches`). Rows later than ``delay`` are left out; read what :func:`stream_split` found
    in time to keep them.
    """
    duration = F.when(F.col("name") == "http_request_duration_ms", F.col("value"))
    sketch = [F.percentile_approx(duration, 0.99).alias("p99_ms")] if approx_p99 else []
    if sketch_k is not None:
        sketch.append(sketched(duration, sketch_k).alias("ms_sketch"))
    rows = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    report = rows.groupBy(F.window("ts", width)).agg(
        F.count_if(F.col("name") == "http_requests_total").alias("reqs"),
        F.avg(duration).alias("avg_ms"), *sketch,
    )
    flat = report.select(F.unix_micros("window.start").alias("bucket_us"), *report.columns[1:])
    return write_stream(flat, out, checkpoint, trigger)


def _last_points(changes: DataFrame) -> DataFrame:
    """The newest point of each series, by time and arrival."""
    return changes.groupBy("series_key").agg(
        F.max("ts_us").alias("ts_us"), F.max_by("seq", arrival_order()).alias("seq"), latest("value", arrival_order()).alias("value"),
    )


def diff_batch(
    out: str, state: str, delay_us: int = 0, chunk_us: int | str | None = MEASURED, release_all: bool = False, merge: int = MERGE
) -> Callable[[DataFrame, int], None]:
    """One batch of :func:`stream_counter_diffs`."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = "series_key string, ts_us long, seq long, value double"
        mine = batch.select(
            series_key(batch).alias("series_key"), micros("ts").alias("ts_us"), F.col("seq").cast("long"), F.col("value").cast("double"),
            F.struct(*[batch[f"`{c}`"] for c in batch.columns]).alias("row"),
        )
        held, clock = _previous(spark, f"{state}/held", batch_id), _previous(spark, f"{state}/clock", batch_id)
        top = clock.first()["top_us"] if clock is not None else None
        waiting = mine if held is None else mine.unionByName(held, allowMissingColumns=True)
        newest = mine.agg(F.max("ts_us")).first()[0]
        top = max((t for t in (top, newest) if t is not None), default=None)
        _merge(spark, f"{state}/last", batch_id, _last_points, merge)
        log = _changes(spark, f"{state}/last", batch_id)
        if log is None:
            known = spark.createDataFrame([], kind)
        else:  # only the series at hand are looked up, so what is written grows with the batch
            touched = small_side(waiting.select("series_key").distinct())
            known = _last_points(log.join(touched, "series_key", "left_semi"))
        last = small_side(known.select("series_key", F.col("ts_us").alias("last_us"), F.col("seq").alias("last_seq")))
        same = (F.col("ts_us") == F.col("last_us")) & (F.col("seq") > F.col("last_seq"))
        after = F.col("last_us").isNull() | (F.col("ts_us") > F.col("last_us")) | F.coalesce(same, F.lit(False))
        due = F.lit(True) if release_all else F.col("ts_us") <= F.lit(top).cast("long") - delay_us
        # a row without a time or not after the last one of its series goes aside, whatever the comparisons made of nulls
        place = F.when(F.col("ts_us").isNull(), "no_time").when(~F.coalesce(after, F.lit(False)), "late").when(due, "used").otherwise("held")
        marked = waiting.join(last, "series_key", "left").withColumn("place", place).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            columns = ("series_key", "ts_us", "seq", "value")
            used = marked.filter("place = 'used'").select(*columns)
            starts = known.select(*columns).join(small_side(used.select("series_key").distinct()), "series_key", "left_semi")
            points = checkpointed(starts.unionByName(used))
            diffs = counter_diffs(points, seq="seq", chunk_us=chunk_us)
            _put(diffs.select("series_key", "ts_us", "diff"), f"{out}/diffs/batch={batch_id}")
            aside = marked.filter("place IN ('no_time', 'late')")
            _put(aside.groupBy("series_key").count(), f"{out}/late/batch={batch_id}")
            _put(aside.select("row.*", F.col("place").alias("reason")), f"{out}/aside/batch={batch_id}")
            _put(_last_points(points), f"{state}/last/batch-{batch_id}")
            _keep(marked.filter("place = 'held'").select(*columns), f"{state}/held", batch_id)
            _keep(spark.createDataFrame([(top,)], "top_us long"), f"{state}/clock", batch_id)
        finally:
            marked.unpersist()

    return work


def stream_counter_diffs(
    samples: DataFrame, out: str, state: str, checkpoint: str, chunk_us: int | str | None = MEASURED, delay_us: int = 0, trigger: dict = ONCE
) -> StreamingQuery:
    """Counter differences across batches.

    Rows are held back until ``delay_us`` has passed between them and the newest row of any series, and then taken in
    the order of time and arrival, as in the batch form; so rows that come out of order by no more than that give the same
    differences. A row not after the last one taken of its series, or without a time, goes whole to ``aside/batch=<id>``
    with the reason, and is counted by series in ``late/batch=<id>``. The state is the last point of each series and the rows
    held back; :func:`finish_counter_diffs` takes the latter at the end. Within a batch the chunked operator keeps a hot
    series apart.
    """
    return _each_batch(samples, diff_batch(out, state, delay_us, chunk_us), checkpoint, trigger=trigger)


def finish_counter_diffs(samples: DataFrame, out: str, state: str, chunk_us: int | str | None = MEASURED) -> None:
    """Take the rows that a stream still holds back, once it has ended; ``samples`` is any table with its columns.

    It writes as the batch after the last one; if it died, it does so again.
    """
    system, path = file_system(samples.sparkSession, f"{state}/clock/*/_SUCCESS")  # written last
    batch_id = 1 + max((int(f.getPath().getParent().getName()) for f in system.globStatus(path) or ()), default=-1)
    diff_batch(out, state, 0, chunk_us, release_all=True)(samples.limit(0), batch_id)


def stream_recent(samples: DataFrame, state: str, checkpoint: str, cap: int, trigger: dict = ONCE) -> StreamingQuery:
    """Keep the ``cap`` newest samples by arrival."""

    def work(batch: DataFrame, batch_id: int) -> None:
        before = _previous(batch.sparkSession, state, batch_id)
        rows = batch if before is None else before.unionByName(batch)
        _keep(keep_newest(rows, cap), state, batch_id)

    return _each_batch(samples, work, checkpoint, trigger=trigger)


def place_attempts(before: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A batch with the ``place`` of each attempt: used, late (not after the last one counted of its target) or unordered."""
    after: Column = F.lit(True)
    marked = batch
    if before is not None:
        last = small_side(before.filter("last_attempt IS NOT NULL").select(F.col("target").alias("_target"), F.col("last_attempt").alias("_last")))
        marked = batch.join(last, F.col("target").eqNullSafe(F.col("_target")), "left")
        after = F.coalesce(F.col("attempt_seq") > F.col("_last"), F.col("_last").isNull())
    place = F.when(F.col("attempt_seq").isNull(), "unordered").when(after, "used").otherwise("late")
    return marked.withColumn("place", place).drop("_target", "_last")


def fold_status(before: DataFrame | None, batch: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Target status after a batch.

    An attempt not after the last one counted of its target came late, and one without a number has no order: either
    changes nothing but ``late``. ``placed`` is the batch with places, if it is at hand.
    """
    marked = place_attempts(before, batch) if placed is None else placed
    fresh = marked.filter("place = 'used'").drop("place")
    aside = marked.filter("place <> 'used'").groupBy("target").agg(F.count(F.lit(1)).alias("late"))
    counts = (*STATUSES, "other")
    picked = ("last_status", "last_ts", "last_samples", "last_duration_ms", "last_attempt")
    attempts = fresh.groupBy("target").agg(F.max("attempt_seq").alias("last_attempt"))
    now = outcome_rollup(fresh).join(failure_streak(fresh), "target").join(attempts, "target").join(aside, "target", "full")
    zero = F.lit(0).cast("bigint")
    if before is None:
        return now.select("target", *picked, *[F.coalesce(c, zero).alias(c) for c in ("consecutive_failures", *counts, "late")])
    b, a = now.alias("b"), before.alias("a")
    joined = a.join(b, "target", "full")
    newer = F.col("b.last_attempt").isNotNull()

    def count(c: str) -> Column:
        return F.coalesce(F.col(f"a.{c}"), zero) + F.coalesce(F.col(f"b.{c}"), zero)

    carried = F.when(F.coalesce(F.col("b.ok"), F.lit(0)) > 0, F.col("b.consecutive_failures")).otherwise(count("consecutive_failures"))
    return joined.select(
        "target", *[F.when(newer, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in picked],
        carried.alias("consecutive_failures"), *[count(c).alias(c) for c in (*counts, "late")],
    )


def status_batch(state: str, aside: str | None = None) -> Callable[[DataFrame, int], None]:
    """One batch of :func:`stream_target_status`."""

    def work(batch: DataFrame, batch_id: int) -> None:
        before = _previous(batch.sparkSession, state, batch_id)
        placed = place_attempts(before, batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if aside:
                _put(placed.filter("place <> 'used'").withColumnRenamed("place", "reason"), f"{aside}/batch={batch_id}")
            _keep(fold_status(before, batch, placed), state, batch_id)
        finally:
            placed.unpersist()

    return work


def stream_target_status(outcomes: DataFrame, state: str, checkpoint: str, aside: str | None = None, trigger: dict = ONCE) -> StreamingQuery:
    """Running status per target; late and unordered attempts are counted, and with ``aside`` kept there whole with the reason."""
    return _each_batch(outcomes, status_batch(state, aside), checkpoint, trigger=trigger)


def _latest_points(changes: DataFrame) -> DataFrame:
    return changes.groupBy("series_key").agg(
        latest("value", F.col("ord")).alias("value"), F.max("ts_us").alias("ts_us"), F.max("ord").alias("ord"),
    )


def latest_batch(state: str, merge: int = MERGE) -> Callable[[DataFrame, int], None]:
    """One batch of :func:`stream_latest_series`."""

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(series_key(batch).alias("series_key"), micros("ts").alias("ts_us"), "seq", "value")
        _merge(batch.sparkSession, state, batch_id, _latest_points, merge)
        _put(_latest_points(rows.withColumn("ord", arrival_order()).drop("seq")), f"{state}/batch-{batch_id}")

    return work


def stream_latest_series(samples: DataFrame, state: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Latest value per series. A batch writes its own series only: the newest of several values is the newest of all."""
    return _each_batch(samples, latest_batch(state), checkpoint, trigger=trigger)


def latest_series(spark: SparkSession, state: str) -> DataFrame:
    """Current table behind :func:`stream_latest_series`."""
    changes = _changes(spark, state)
    if changes is None:
        raise FileNotFoundError(f"no batch has finished in {state}")
    return _latest_points(changes).drop("ord")


def dedupe_payloads(payloads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop payloads replayed within the delay; ``scrape_ts`` becomes a TIMESTAMP, as watermarks need.

    Spark also drops what is later than the delay, copy or not; read what :func:`stream_split` found in time to keep it.
    """
    timed = payloads.withColumn("scrape_ts", F.col("scrape_ts").cast("timestamp"))
    return timed.withWatermark("scrape_ts", delay).dropDuplicatesWithinWatermark(["scrape_id"])


def write_stream(stream: DataFrame, out: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**trigger).format("parquet").option("path", out).start()
    )
