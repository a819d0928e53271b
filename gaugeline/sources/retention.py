"""Moving rows from the recent table to history, and expiring history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import moment
from ..session import file_system
from .history import commit, current, write_ranges
from .metrics import EXPORT_PREFIX, EXPORT_SUFFIX, METRICS_SCHEMA, list_exports

# Default horizons in days.
RETENTION_DAYS = 30
PURGE_DAYS = 32


def split_by_age(hot: DataFrame, cutoff: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Rows to move out (before the cutoff) and rows to keep; a row without a time is kept."""
    old = F.coalesce(F.col("ts") < moment(cutoff, dict(hot.dtypes)["ts"]), F.lit(False))
    return hot.filter(old), hot.filter(~old)


def compact(hot: DataFrame, cutoff: dt.datetime, folder: str, stamp: str, hot_path: str) -> str:
    """Write rows older than the cutoff as an export of daily ZSTD partitions and the rest as a new recent table.

    Returns the path of the export, which listing, reading and purging find by its name. What an earlier run that died
    left at the two paths is replaced; readers go on with the old tables until :func:`compact_and_switch` commits.
    Rows are clustered by name within a day, which lets readers skip files and row groups by name; the
    day is cut into name and time ranges, so no task has to hold a whole day.
    """
    old, young = split_by_age(hot, cutoff)
    cold_path = export_path(folder, stamp)
    (
        old.withColumn("dt", F.to_date("ts"))
        .repartitionByRange("dt", "name", "ts")
        .sortWithinPartitions("dt", "name", "ts")
        .write.mode("overwrite").partitionBy("dt").option("compression", "zstd").parquet(cold_path)
    )
    write_ranges(hot.sparkSession, cold_path)
    young.write.mode("overwrite").option("compression", "zstd").parquet(hot_path)
    return cold_path


def compact_and_switch(spark: SparkSession, root: str, cutoff: dt.datetime, stamp: str) -> int:
    """Compact the committed recent table of a root folder and switch its readers; returns the number of the new state.

    Readers of :func:`gaugeline.sources.history.read_committed` see the old state until the new one is committed by one
    rename, so a run that dies in between leaves every row readable once, and its successor writes over what it left. The
    old recent table stays for readers that still use it and for :func:`~gaugeline.sources.history.roll_back`.
    """
    before, recent, exports = current(spark, root)
    if export_path(root, stamp) in exports:
        raise FileExistsError(f"export {stamp} is committed already")
    hot_path = f"{root.rstrip('/')}/recent-{before + 1:012d}"
    export = compact(spark.read.parquet(recent), cutoff, root, stamp, hot_path)
    return commit(spark, root, hot_path, [*exports, export], before)


def export_path(folder: str, stamp: str) -> str:
    return f"{folder.rstrip('/')}/{EXPORT_PREFIX}{stamp}{EXPORT_SUFFIX}"


def write_export(metrics: DataFrame, folder: str, stamp: str) -> str:
    """Write one dated export (a folder of part files under the export name); returns its path."""
    path = export_path(folder, stamp)
    columns = [F.col(f.name).cast(f.dataType) for f in METRICS_SCHEMA]
    metrics.select(*columns).write.option("compression", "zstd").parquet(path)
    return path


def check_horizons(retention_days: int, purge_days: int) -> None:
    if retention_days <= 0:
        raise ValueError("retention must be at least one day")
    if purge_days <= retention_days:
        raise ValueError("the purge horizon must lie beyond retention")


def expired_exports(
    spark: SparkSession, folder: str, as_of: dt.datetime, purge_days: int = PURGE_DAYS
) -> DataFrame:
    """Exports last changed before the purge horizon; other files never appear. Deletes nothing."""
    before = as_of - dt.timedelta(days=purge_days)
    return list_exports(spark, folder).filter(F.col("modified") < moment(before, "timestamp"))


def unexpired_rows(metrics: DataFrame, as_of: dt.datetime, purge_days: int = PURGE_DAYS) -> DataFrame:
    """Row form of the purge: history younger than the horizon."""
    return metrics.filter(F.col("ts") >= moment(as_of - dt.timedelta(days=purge_days), dict(metrics.dtypes)["ts"]))


def purge(
    spark: SparkSession, folder: str, as_of: dt.datetime, purge_days: int = PURGE_DAYS, dry_run: bool = True
) -> int:
    """Delete expired exports and return how many; by default only counts them.

    An export goes in one call to its own file system, whatever it holds; there are as many as the horizon leaves.
    """
    doomed = expired_exports(spark, folder, as_of, purge_days)
    if dry_run:
        return doomed.count()
    removed = 0
    for row in doomed.toLocalIterator():
        system, path = file_system(spark, row["path"])
        removed += bool(system.delete(path, True))
        folder, name = row["path"].rsplit("/", 1)
        system, path = file_system(spark, f"{folder}/_ranges/{name}")
        system.delete(path, True)
    return removed
