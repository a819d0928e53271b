"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Largest dimension that may be broadcast, and the bytes it may take as JSON text.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Put the session into UTC, which every timestamp-to-micros step relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require_utc() -> None:
    spark = SparkSession.getActiveSession()
    zone = spark.conf.get("spark.sql.session.timeZone") if spark else "UTC"
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00", "GMT"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, got {zone}")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local-mode session without that setting falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path below the application's part of the shared folder; nothing is created yet."""
    return f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Delete what this application wrote below :func:`work_dir`, once no result that reads it is needed any more."""
    system, path = file_system(spark, _run_dir(spark))
    system.delete(path, True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path as it takes it: whatever Spark can read, this can list and delete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise a small intermediate reliably, so that it is computed once."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def size_columns(df: DataFrame) -> list[Column]:
    """Aggregates for the rows of a table and their bytes as JSON text."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("bytes"),
    ]


def broadcast_if(df: DataFrame, rows: int, size: int) -> DataFrame:
    """Hint a broadcast if the measured size allows it; a larger side is left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def small_side(df: DataFrame) -> DataFrame:
    """Measure a join side and hint a broadcast only if it is small.

    The rows are checkpointed first, so measuring does not compute them twice.
    """
    held = checkpointed(df)
    rows, size = held.agg(*size_columns(held)).first()
    return broadcast_if(held, rows, size)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write an intermediate once into the shared folder, with options of the writer, and read it back.

    Later plans read only the columns they need, and a lost executor costs no recomputation.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, label)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)
