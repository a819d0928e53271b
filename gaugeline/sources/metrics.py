"""Reading metric history: which files, and as which table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import file_system

# Export file naming.
EXPORT_PREFIX = "metrics_cold_"
EXPORT_SUFFIX = ".parquet"

# The five columns every history file is read as.
METRICS_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("labels", T.StringType()),
    ]
)


_DAY_FOLDER = re.compile(r"^(.*)/dt=(\d{4}-\d{2}-\d{2}|__HIVE_DEFAULT_PARTITION__)/[^/]+$")


def _by_day(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Paths without day folders, and those with them by the folder the days stand in.

    A path may be a file in a day folder. One listing call is made for each folder, none for a file in a day folder.
    """
    plain, dated = [], {}
    for path in paths:
        if inside := _DAY_FOLDER.match(path):
            dated.setdefault(inside[1], []).append(path)
            continue
        system, days = file_system(spark, f"{path.rstrip('/')}/dt=*")
        if system.globStatus(days):
            dated.setdefault(path.rstrip("/"), []).append(path)
        else:
            plain.append(path)
    return plain, dated


def read_metrics(spark: SparkSession, paths: Sequence[str] | str, extra: bool = False, days: bool = False) -> DataFrame:
    """Many files as one table, columns matched by name and missing ones null.

    Just the five contract columns are read, by a schema Spark is given up front, so no file footer
    is read before the query runs. ``extra=True`` adds further columns, and reads every footer for it.
    ``days=True`` adds the UTC day of a row as ``dt``. Where an export has a folder for each day, that is the
    folder's, and range predicates leave the folders of other days unopened.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    if not listed:
        raise ValueError("no metric files to read")
    plain, dated = _by_day(spark, listed) if days else (listed, {})
    tables = [spark.read.option("recursiveFileLookup", True)] if plain else []  # part files at any depth
    sources = [plain] if plain else []
    for base, files in dated.items():
        tables.append(spark.read.option("basePath", base))
        sources.append(files)
    if extra:
        found = [t.option("mergeSchema", True).parquet(*s) for t, s in zip(tables, sources, strict=True)]
        found = [t.withColumn("dt", F.col("dt").cast("date")) if i >= len(found) - len(dated) else t for i, t in enumerate(found)]
        missing = {f.name: F.lit(None).cast(f.dataType) for t in found for f in METRICS_SCHEMA if all(f.name not in u.columns for u in found)}
    else:
        with_day = T.StructType([*METRICS_SCHEMA.fields, T.StructField("dt", T.DateType())])
        found = [t.schema(METRICS_SCHEMA if s is plain else with_day).parquet(*s) for t, s in zip(tables, sources, strict=True)]
        missing = {}
    if plain and days:
        found[0] = found[0].withColumn("dt", F.to_date("ts"))
    whole = union_by_name(found)
    return whole.withColumns(missing) if missing else whole


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def is_export_name(name: str | Column) -> Column:
    """Strict check of an export file name; paths and parent references never pass."""
    n = F.col(name) if isinstance(name, str) else name
    return (
        n.startswith(EXPORT_PREFIX) & n.endswith(EXPORT_SUFFIX)
        & ~n.contains("/") & ~n.contains("\\") & ~n.contains("..")
    )


def list_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Exports in a folder, oldest name first: ``path, name, modified, bytes``. No content is read.

    An export is one file, or a folder of part files as Spark writes it, with or without folders for days.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    export = F.regexp_extract("path", f"^(.*/({EXPORT_PREFIX}[^/]*\\{EXPORT_SUFFIX}))(?:/.*)?$", 1)
    return (
        files.select(export.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
        .withColumn("name", F.element_at(F.split("path", "/"), -1))
        .filter(is_export_name("name"))
        .groupBy("path", "name")
        .agg(F.max("modified").alias("modified"), F.sum("bytes").alias("bytes"))
        .orderBy("name")
    )


def newest_export(spark: SparkSession, folder: str) -> DataFrame:
    return list_exports(spark, folder).agg(F.max_by("path", "name").alias("path"))


def resolve_paths(spark: SparkSession, base: str) -> list[str]:
    """Files a user means by ``base``: one Parquet file, or the exports of a folder.

    The list is as long as the number of export files, which the purge horizon bounds.
    """
    wanted = base.strip().rstrip("/")
    if not wanted:
        raise ValueError("empty data source")
    if wanted.lower().endswith(EXPORT_SUFFIX):
        return [wanted]
    found = [row["path"] for row in list_exports(spark, wanted).select("path").toLocalIterator()]
    if not found:
        raise FileNotFoundError(f"no {EXPORT_PREFIX}*{EXPORT_SUFFIX} files in {wanted}")
    return found
