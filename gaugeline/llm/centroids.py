"""Clustering of integer vectors around centroids, with distances read from scalar lookup tables.

A component takes few integer values, so the squared difference to each centroid is worked out once for every value
that occurs in a dimension, not once for every vector. The distance of a vector is then one table row for each
dimension, gathered with numpy and summed. All numbers are integers, so results do not depend on how rows are spread.

Defined results: a vector that is null, of another length, or has a null, NaN or infinite component is left out, as
the contract says. One with an integer beyond ``WIDEST`` would need squared distances beyond a long: it is returned
without a cluster or distance. A null ``vec_id`` is hashed as an empty name and returned as null; repeated rows are
rows of their own, and as many of them as are among the smallest hashes start a centroid. With fewer vectors than
centroids, all of them start one. No vectors give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import stored

#: Largest absolute integer: 64 squared differences of twice this fit a long.
WIDEST = 2**27
#: Vectors whose distances are worked out together.
BLOCK = 65_536


def quantised(vectors: DataFrame, vector: str, dimensions: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``, floor(scale * x) of each component; ``v`` is null where it would be too wide."""
    column = F.col(vector)
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    narrow = F.forall(column, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(WIDEST)))
    kept = vectors.where((F.size(column) == dimensions) & finite)
    return kept.select("vec_id", F.when(narrow, scaled.cast("array<int>")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of seed and id, in that order; equal ids in the order of their vectors."""
    name = F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.where("v IS NOT NULL").select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([row["v"] for row in chosen], dtype=np.int64)


def table_distances(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every vector and its squared distance, from one table for each dimension.

    A table has a row for each integer that occurs in the dimension and a column for each centroid.
    """
    total = np.zeros((len(block), len(centroids)), dtype=np.int64)
    for d in range(block.shape[1]):
        values = block[:, d]
        low, high = int(values.min()), int(values.max())
        if high - low < 4 * len(values):
            offsets = values - low
            seen = np.zeros(high - low + 1, dtype=bool)
            seen[offsets] = True
            occurring = np.flatnonzero(seen) + low
            places = (np.cumsum(seen) - 1)[offsets]
        else:
            occurring, places = np.unique(values, return_inverse=True)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        total += table[places]
    nearest = total.argmin(axis=1)
    return nearest, total[np.arange(len(block)), nearest]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task in blocks of about ``BLOCK``, so that a table serves many vectors."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BLOCK:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if rows:
        yield pd.concat(held, ignore_index=True)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, and each centroid to the floor of its vectors' mean.

    A task sends one row of sums for each centroid, whatever it read.
    """
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for part in _blocks(batches):
            block = np.stack(part["v"].to_numpy()).astype(np.int64)
            nearest, _ = table_distances(block, centroids)
            order = np.argsort(nearest, kind="stable")
            found, start = np.unique(nearest[order], return_index=True)
            total[found] += np.add.reduceat(block[order], start, axis=0)
            count += np.bincount(nearest, minlength=k)
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used, "n": count[used], "s": list(total[used])})

    parts = rows.where("v IS NOT NULL").select("v").mapInPandas(sums, "cluster int, n long, s array<long>")
    each = parts.select("cluster", "n", F.posexplode("s").alias("d", "s"))
    totals = each.groupBy("cluster", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    after = centroids.copy()
    for row in totals.collect():  # k * dimensions rows
        after[row["cluster"], row["d"]] = int(row["s"]) // row["n"]
    return after


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id``, nearest ``cluster`` and squared ``distance`` of every vector; both null for one that is too wide."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(batches):
            block = np.stack(part["v"].to_numpy()).astype(np.int64)
            cluster, distance = table_distances(block, centroids)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": cluster, "distance": distance})

    wide = rows.where("v IS NULL").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    return rows.where("v IS NOT NULL").mapInPandas(nearest, schema).unionByName(wide)


def cluster(
    vectors: DataFrame, vector: str = "embedding", dimensions: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1:"
) -> DataFrame:
    """Clusters of all vectors after some rounds.

    Returns ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia`` and ``inertia`` (distance summed over the
    cluster and over all; null beyond a long) and ``centroid``, the integers of the cluster's final centroid.
    """
    rows = stored(quantised(vectors, vector, dimensions, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        centroids = np.zeros((0, dimensions), dtype=np.int64)
        near = rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    else:
        for _ in range(rounds):
            centroids = moved(rows, centroids)
        near = stored(assigned(rows, centroids), "assigned")
    spark = vectors.sparkSession
    sums = near.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total, of = sum(int(r["s"]) for r in sums), {r["cluster"]: int(r["s"]) for r in sums}
    fits = lambda n: n if n < 2**63 else None
    final = spark.createDataFrame(
        [(c, fits(of.get(c, 0)), fits(total), [int(x) for x in centroids[c]]) for c in range(len(centroids))],
        "cluster int, cluster_inertia long, inertia long, centroid array<int>",
    )
    return near.join(F.broadcast(final), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
