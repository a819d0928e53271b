"""Distributed sorting with comparison of neighbours: which keys belong to several owners."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import stored


def common_words(one: str, two: str) -> int:
    """Length of the longest common prefix of two strings, in words between blanks."""
    if one == two:
        return one.count(" ") + 1
    words = zip(one.split(" "), two.split(" "), strict=False)
    return sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], words))


def shared_runs(rows: DataFrame, key: str, owner: str, least: int | str = 2, alone: bool = False, words: int | None = None) -> DataFrame:
    """The rows whose key at least ``least`` owners have; with ``alone``, all rows and a column ``shared``.

    ``least`` may name a column of numbers, one for each key. With ``words`` the keys are suffixes of texts, written out to
    that many words: in the sorted order neighbours belong together whose longest common prefix has as many.

    Rows are sorted by key and owner over range partitions, whose bounds include the owner, so that a frequent key is
    spread over many of them. Within a partition equal neighbours make runs. Only the first and last run can go on in
    another partition: what is open there is settled by the owners that each partition counts for them, two keys for
    each partition.

    Key (with ``words`` a string) and owner are longs without nulls. The input is read more than once and should be stored.
    """
    names = rows.columns

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        part = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        k, o = part[key].to_numpy(), part[owner].to_numpy()
        if words is None:
            turn = np.concatenate([[True], k[1:] != k[:-1]])
        else:
            turn = np.array([True, *(common_words(a, b) < words for a, b in pairwise(k))])
        run = np.cumsum(turn) - 1
        owners = np.add.reduceat(turn | np.concatenate([[True], o[1:] != o[:-1]]), np.flatnonzero(turn))
        shared = owners[run] >= (part[least].to_numpy() if isinstance(least, str) else least)
        edge = (run == 0) | (run == run[-1])
        at_edge = turn & edge
        part = part.assign(shared=shared, open=edge & ~shared, owners=np.where(at_edge, owners[run], 0).astype(np.int64))
        yield part if alone else part[shared | edge]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = rows.repartitionByRange(key, owner).sortWithinPartitions(key, owner)
    marked = stored(ordered.mapInPandas(neighbours, schema + ", shared boolean, open boolean, owners long"), "runs")
    bound = F.col(least) if isinstance(least, str) else F.lit(least)
    totals = marked.where("owners > 0").groupBy(key).agg(F.sum("owners").alias("total"), F.max(bound).alias("bound"))
    edges = totals.where("total >= bound").select(key, F.lit(True).alias("goes_on"))
    settled = marked.where("NOT open").select(*names, "shared")
    opened = marked.where("open").join(F.broadcast(edges), key, "left").select(*names, F.coalesce("goes_on", F.lit(False)).alias("shared"))
    every = settled.unionByName(opened)
    return every if alone else every.where("shared").select(*names)
