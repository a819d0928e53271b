"""The recent window: its span, size, names, and what falls out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import micros
from .series import running_total

# Fixed value: samples the recent window holds.
DEFAULT_CAP = 20_000
_PUSH_CHUNK = 1 << 22


def metric_names(samples: DataFrame) -> DataFrame:
    return samples.select("name").distinct().orderBy("name")


def buffer_span(samples: DataFrame) -> DataFrame:
    """Time of the first and last sample by arrival; nulls when there are none."""
    at = micros("ts")
    ends = samples.agg(F.min_by(at, "seq").alias("oldest_us"), F.max_by(at, "seq").alias("newest_us"))
    million = F.lit(1_000_000).cast("bigint")
    return ends.select(
        "*",
        F.call_function("div", "oldest_us", million).alias("oldest_s"),
        F.call_function("div", "newest_us", million).alias("newest_s"),
    )


def buffer_occupancy(samples: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.lit(cap).cast("bigint").alias("capacity"))


def keep_newest(samples: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    """The ``cap`` samples that arrived last.

    A plain top-n would send ``cap`` rows from every task to one. So the distance to the newest
    arrival is first counted in about sixty logarithmic bins, and only rows above the bin in
    which the cap is reached take part in the top-n. Rows without an arrival number count as the oldest.
    """
    samples = samples.withColumn("_seq", F.coalesce("seq", F.lit(-(2**61))))
    newest = samples.agg(F.max("_seq")).scalar()
    distance = newest - F.col("_seq")
    bins = (
        samples.select("_seq", F.floor(F.log2(distance + 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("c"), F.min("_seq").alias("from_seq"))
    )
    nearer = F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    cutoff = bins.withColumn("nearer", F.coalesce(nearer, F.lit(0))).filter(F.col("nearer") < cap)
    since = cutoff.agg(F.min("from_seq")).scalar()
    return samples.filter(F.col("_seq") >= since).orderBy(F.desc("_seq")).limit(cap).drop("_seq")


def eviction_counts(pushes: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    """Samples pushed out, per target whose push did it.

    ``pushes`` has one row per push: ``target``, ``seq`` (unique arrival number) and ``n`` samples.
    """
    total = running_total(pushes.filter("n > 0"), [], "seq", "n", _PUSH_CHUNK, out="upto")
    over = F.greatest(F.col("upto") - cap, F.lit(0)) - F.greatest(F.col("upto") - F.col("n") - cap, F.lit(0))
    return (
        total.groupBy("target")
        .agg(F.sum(over).alias("dropped"))
        .filter("dropped > 0")
        .select("target", F.lit("over_cap").alias("reason"), "dropped")
    )
