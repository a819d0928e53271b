"""History that is read by the file: day folders, a table of what each file spans, and the commit that says what counts.

An export written by :func:`gaugeline.sources.retention.compact` has a folder for each UTC day and, beside the exports in
``_ranges``, one row per part file with its first and last name and time. A query of a day and a name then opens the
files that can hold it and no others; exports without either are read as before.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import predicates as P
from ..functions.scalars import epoch_micros, micros
from ..session import file_system
from .metrics import read_metrics, resolve_paths

#: Files a query may name one by one. Beyond that its exports are read as folders, pruned by day and row group.
MAX_PICKED = 20_000


def _ranges_path(export: str) -> str:
    folder, name = export.rstrip("/").rsplit("/", 1)
    return f"{folder}/_ranges/{name}"


def write_ranges(spark: SparkSession, export: str) -> None:
    """Write what each file of an export spans. Two of its columns are read; a null name or time widens nothing."""
    rows = read_metrics(spark, export)
    ranges = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("name").alias("first_name"), F.max("name").alias("last_name"),
        F.min(micros("ts")).alias("first_us"), F.max(micros("ts")).alias("last_us"), F.count(F.lit(1)).alias("rows"),
    )
    ranges.write.mode("overwrite").parquet(_ranges_path(export))


def file_ranges(spark: SparkSession, exports: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """The ranges of all files of those exports that have them, and the exports that have none."""
    with_ranges, without = [], []
    for export in exports:
        system, done = file_system(spark, f"{_ranges_path(export)}/_SUCCESS")
        (with_ranges if system.exists(done) else without).append(export)
    return (spark.read.parquet(*map(_ranges_path, with_ranges)) if with_ranges else None), without


def _bounds(start: dt.datetime | None, end: dt.datetime | None) -> tuple[int | None, int | None]:
    return tuple(None if when is None else epoch_micros(when) for when in (start, end))


def read_history(
    spark: SparkSession, base: str | Sequence[str], start: dt.datetime | None = None, end: dt.datetime | None = None,
    names: Sequence[str] | None = None, max_picked: int = MAX_PICKED,
) -> DataFrame:
    """Rows of a closed time range and of some metrics, from the files that can hold them.

    ``base`` is a folder of exports, one export, or a list of exports. ``dt`` is the UTC day of a row.
    """
    exports = resolve_paths(spark, base) if isinstance(base, str) else list(base)
    ranges, paths = file_ranges(spark, exports)
    low, high = _bounds(start, end)
    if ranges is not None and (low, high, names) != (None, None, None):
        if low is not None:
            ranges = ranges.filter(F.col("last_us") >= low)
        if high is not None:
            ranges = ranges.filter(F.col("first_us") <= high)
        if names is not None:
            hit = F.lit(False)
            for name in names:
                hit = hit | ((F.col("first_name") <= name) & (F.col("last_name") >= name))
            ranges = ranges.filter(hit)
        picked = [row["file"] for row in ranges.select("file").limit(max_picked + 1).collect()]
        paths = paths + picked if len(picked) <= max_picked else exports
    else:
        paths = exports
    if not paths:  # no file can hold such a row; the schema is that of an export
        return read_metrics(spark, exports[:1], days=True).limit(0)
    rows = read_metrics(spark, paths, days=True)
    kind = dict(rows.dtypes)["ts"]
    if start is not None:
        rows = rows.filter(P.not_before(rows, start, kind))
    if end is not None:
        rows = rows.filter(P.not_after(rows, end, kind))
    return rows if names is None else rows.filter(P.named_any(names))


# What counts: a numbered file names the recent table and the exports of one state. A state appears whole, by a rename.


def _commit_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/_commits/{number:012d}.json"


def commits(spark: SparkSession, root: str) -> list[int]:
    system, found = file_system(spark, f"{root.rstrip('/')}/_commits/*.json")
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in system.globStatus(found) or ())


def commit(spark: SparkSession, root: str, recent: str, exports: Sequence[str], after: int) -> int:
    """Make a state the current one. It must follow the state ``after`` (-1: none); a writer that came second is refused."""
    number = after + 1
    system, final = file_system(spark, _commit_path(root, number))
    _, draft = file_system(spark, f"{root.rstrip('/')}/_commits/_draft-{number}-{spark.sparkContext.applicationId}")
    if system.exists(final):
        raise FileExistsError(f"state {number} of {root} is taken; read the current one and try again")
    out = system.create(draft, True)
    try:
        out.write(bytearray(json.dumps({"recent": recent, "exports": list(exports)}).encode()))
    finally:
        out.close()
    if not system.rename(draft, final):
        raise FileExistsError(f"state {number} of {root} is taken; read the current one and try again")
    return number


def current(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, str, list[str]]:
    """Number, recent table and exports of the current state, or of a given one."""
    found = commits(spark, root)
    if not found:
        raise FileNotFoundError(f"nothing is committed in {root}")
    number = found[-1] if number is None else number
    state = json.loads(spark.read.option("wholetext", True).text(_commit_path(root, number)).first()[0])
    return number, state["recent"], state["exports"]


def roll_back(spark: SparkSession, root: str, to: int) -> int:
    """Make an earlier state the current one again, as a new state; its tables must not have been purged."""
    latest, _, _ = current(spark, root)
    _, recent, exports = current(spark, root, to)
    return commit(spark, root, recent, exports, latest)


def read_committed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame | None]:
    """The recent table and the history of the current state; null without exports. Every row is in one of them."""
    _, recent, exports = current(spark, root)
    return spark.read.parquet(recent), (read_history(spark, exports) if exports else None)
