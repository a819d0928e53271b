"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def components(edges: DataFrame) -> DataFrame:
    """(u, root): the smallest node reachable, for every node of an edge (u, v), by alternating star contractions.

    Each round hangs larger neighbours, then all neighbours, under the smallest one known. A round is written to the
    shared folder; the driver sees its row count and a sum of hashes.
    """
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "components")
        last, seen = seen, state(now)
        if last == seen:
            break
    return now.select("u", F.col("v").alias("root"))
