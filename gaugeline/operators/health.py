"""Target health, collector health and job rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import small_side
from .ring import buffer_occupancy, buffer_span

# Outcome states and the number of finished jobs shown.
STATUSES = ("ok", "fetch_error", "parse_error")
RECENT_JOBS = 100


def failure_streak(outcomes: DataFrame) -> DataFrame:
    """Failures since the last success per target.

    Two partially aggregated passes: a busy target never comes together in one task, as it would
    in a window over its attempts. The first pass leaves one row per target.
    """
    last_ok = outcomes.groupBy("target").agg(
        F.coalesce(F.max(F.when(F.col("status") == "ok", F.col("attempt_seq"))), F.lit(-(2**63))).alias("last_ok")
    )
    held = small_side(last_ok)
    after = outcomes.filter(F.col("status") != "ok").join(held, "target").filter(F.col("attempt_seq") > F.col("last_ok"))
    streaks = after.groupBy("target").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    return held.select("target").join(streaks, "target", "left").select(
        "target", F.coalesce("consecutive_failures", F.lit(0).cast("bigint")).alias("consecutive_failures")
    )


def _newest(column: str) -> Column:
    return F.max_by(column, "attempt_seq").alias(f"last_{column}")


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    """Last attempt and lifetime counts per target. Samples are those of the last attempt, failed or not.

    A state that is not listed counts as ``other``, and as a last status it is null.
    """
    # The state travels as a number: a text buffer would make Spark sort all attempts.
    known = F.array(*[F.lit(s) for s in STATUSES])
    coded = outcomes.withColumn("_state", F.nullif(F.array_position(known, F.col("status")), F.lit(0).cast("bigint")))
    rollup = coded.groupBy("target").agg(
        F.max_by("_state", "attempt_seq").alias("_state"),
        _newest("ts"), _newest("samples"), _newest("duration_ms"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).alias("other"),
    )
    return rollup.withColumn("last_status", F.try_element_at(known, F.col("_state").cast("int"))).drop("_state")


def target_status(outcomes: DataFrame, targets: DataFrame) -> DataFrame:
    """Status of every registered target; attempts of unknown targets do not count."""
    known = targets.select(F.col("name").alias("target")).distinct()
    mine = outcomes.join(small_side(known), "target", "left_semi")
    rollup = outcome_rollup(mine).join(failure_streak(mine), "target")
    zero = F.lit(0).cast("bigint")
    return targets.withColumnRenamed("name", "target").join(rollup, "target", "left").select(
        "target", *[c for c in targets.columns if c != "name"],
        "last_status", "last_ts",
        *[F.coalesce(c, zero).alias(c) for c in ("last_samples", "last_duration_ms", "consecutive_failures", *STATUSES, "other")],
    )


def collector_health(status: DataFrame) -> DataFrame:
    """degraded if any target is failing, starting if a swept target was never scraped, else ok."""
    failing = F.coalesce(F.bool_or(F.col("consecutive_failures") > 0), F.lit(False))
    waiting = F.col("enabled") & (F.col("mode") == "recurring") & F.col("last_ts").isNull()
    starting = F.coalesce(F.bool_or(waiting), F.lit(False))
    state = F.when(failing, "degraded").when(starting, "starting").otherwise("ok")
    return status.agg(state.alias("status"), F.count(F.lit(1)).alias("targets"))


def snapshot(status: DataFrame, samples: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row for a dashboard: state and targets, what the recent window covers and holds, and the queue."""
    window, held, queue = (F.struct("oldest_us", "newest_us"), F.struct("samples", "capacity"), F.struct("depth", "running", "done", "failed"))
    row = collector_health(status).select(
        "*", buffer_span(samples).select(window).scalar().alias("window"), buffer_occupancy(samples).select(held).scalar().alias("held"),
        job_summary(jobs).select(queue).scalar().alias("queue"),
    )
    return row.select("status", "targets", "window.*", "held.*", "queue.*")


def job_summary(jobs: DataFrame, cap: int = 256, paused: bool = False, frozen: bool = False) -> DataFrame:
    """Queue depth, running jobs and lifetime results."""
    def of(state: str) -> Column:
        return F.count_if(F.col("state") == state)

    return jobs.agg(
        of("pending").alias("depth"), F.lit(cap).alias("cap"), F.lit(paused).alias("paused"), F.lit(frozen).alias("frozen"),
        of("running").alias("running"), of("done").alias("done"), of("failed").alias("failed"),
    )


def recent_jobs(jobs: DataFrame, n: int = RECENT_JOBS) -> DataFrame:
    """Finished and cancelled jobs, newest first."""
    done = jobs.filter(F.col("state").isin("done", "failed", "cancelled"))
    return done.orderBy(F.desc("finished_at"), F.desc("job_id")).limit(n)
