"""Exact interpolated quantiles per group without holding a group in one task.

The built-in percentile keeps every distinct value of a group in one buffer. Here values are
counted in bins that grow with their logarithm; only the bins that hold a wanted rank are looked
into again, and within them equal values are counted together. No task sees more than the bins
of a group (at most 2**23) or the distinct values of one bin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if, checkpointed, size_columns

# A fine bin spans a factor of e**(2**-30), so at most 2**22 different doubles fall into it.
_FINE = 2.0**30
_COARSE_SHIFT = 20
_OFFSET = 2**41
DIRECT_ROWS = 2**22


def _fine_bin(v: Column) -> Column:
    """A BIGINT that never falls as the value grows; NaN sorts above everything."""
    inf = float("inf")
    size = F.floor(F.ln(F.abs(v)) * F.lit(_FINE)) + F.lit(_OFFSET)
    return (
        F.when(F.isnan(v), F.lit(2**43))
        .when(v == inf, F.lit(2**42 + 2**21))
        .when(v == -inf, F.lit(-(2**42) - 2**21))
        .when(v == 0, F.lit(0).cast("bigint"))
        .when(v > 0, size)
        .otherwise(-size)
    )


def _ranks(n: Column, probability: float) -> tuple[Column, Column, Column]:
    at = (n - 1) * F.lit(float(probability))
    return at, F.floor(at), F.ceil(at)


def _holding(counts: DataFrame, keys: Sequence[str], by: str, probabilities: Sequence[float]) -> DataFrame:
    """Keep the bins that hold a wanted rank; ``below`` counts the values under the bin."""
    ordered = Window.partitionBy(*keys, *(["_part"] if "_part" in counts.columns else [])).orderBy(by)
    upto = F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto + F.col("_below")).withColumn("_from", F.col("_upto") - F.col("_c"))
    wanted = F.lit(False)
    for p in probabilities:
        _, low, high = _ranks(F.col("_n"), p)
        for rank in (low, high):
            wanted = wanted | ((F.col("_from") <= rank) & (rank < F.col("_upto")))
    return ranked.filter(wanted)


def _in_bins(rows: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the chosen bins; a null key is a group like any other."""
    right = bins.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_bin_part"), "_n", "_below")
    same = F.col("_part") == F.col("_bin_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return rows.join(right, same).drop("_bin_part", *[f"_key_{i}" for i in range(len(keys))])


def _held(bins: DataFrame) -> tuple[DataFrame, int]:
    """The chosen bins, computed and ready to join, and the count of the fullest."""
    held = checkpointed(bins)
    rows, size, fullest = held.agg(*size_columns(held), F.max("_c")).first()
    return broadcast_if(held.drop("_c"), rows, size), fullest or 0


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    direct_rows: int = DIRECT_ROWS,
    riding: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group with a column per entry of ``probabilities``; nulls are ignored.

    Runs the first counting pass at once, because the second depends on how full the bins are.
    ``riding`` are further aggregates that add up, such as counts and sums: they are taken in the
    counting pass over all rows, and then every group has a row, also one without values.
    """
    wanted = list(probabilities.values())
    binned = rows.withColumn("_v", F.col(value)).withColumn("_fine", _fine_bin(F.col("_v")))
    binned = binned.withColumn("_part", F.when(F.col("_v").isNotNull(), F.shiftright("_fine", _COARSE_SHIFT)))
    base = binned.filter(F.col("_v").isNotNull()).select(*keys, "_v", "_fine")
    coarse = base.withColumn("_part", F.shiftright("_fine", _COARSE_SHIFT))

    if riding:
        all_counts = checkpointed(binned.groupBy(*keys, "_part").agg(F.count("_v").alias("_c"), *[c.alias(n) for n, c in riding.items()]))
        counts = all_counts.filter(F.col("_part").isNotNull()).select(*keys, "_part", "_c")
    else:
        counts = coarse.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    sized = counts.withColumnRenamed("_part", "_bin").withColumn(
        "_n", F.sum("_c").over(Window.partitionBy(*keys))
    ).withColumn("_below", F.lit(0).cast("bigint"))
    bins = _holding(sized, keys, "_bin", wanted).select(
        *keys, F.col("_bin").alias("_part"), "_n", F.col("_from").alias("_below"), "_c"
    )
    bins, fullest = _held(bins)

    inner = coarse
    if fullest > direct_rows:
        near = _in_bins(coarse, bins, keys)
        finer = near.groupBy(*keys, "_part", "_n", "_below", "_fine").agg(F.count(F.lit(1)).alias("_c"))
        bins, _ = _held(
            _holding(finer, keys, "_fine", wanted).select(
                *keys, F.col("_fine").alias("_part"), "_n", F.col("_from").alias("_below"), "_c"
            )
        )
        inner = base.withColumnRenamed("_fine", "_part")

    values = (
        _in_bins(inner, bins, keys)
        .groupBy(*keys, "_part", "_n", "_below", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    found = _holding(values, keys, "_v", wanted)
    picks, result = [], [F.col(k) for k in keys]
    for name, p in probabilities.items():
        at, low, high = _ranks(F.col("_n"), p)
        for side, rank in (("lo", low), ("hi", high)):
            inside = (F.col("_from") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - low).alias(f"_{name}_at"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        result.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col(f"_{name}_at")).alias(name))
    ranked = found.groupBy(*keys).agg(*picks).select(*result)
    if not riding:
        return ranked
    totals = all_counts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in riding])
    same = F.lit(True)
    for i, k in enumerate(keys):
        ranked = ranked.withColumnRenamed(k, f"_key_{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return totals.join(ranked, same, "left").drop(*[f"_key_{i}" for i in range(len(keys))])
