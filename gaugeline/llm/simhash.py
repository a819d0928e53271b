"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint of its word shingles. All pairs of different fingerprints are compared exactly,
tile against tile, except where population counts already differ by more than the radius: flipping one bit moves the
count of one half (or quarter) of a fingerprint by one, so counts bound the distance from below. Links within a tile
pair leave it as a spanning forest, never as pairs; components are then found by star contraction.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; texts with fewer words than a
shingle give one shingle of all their words; repeated rows share a fingerprint and stay separate rows; a null doc_id
never names a component unless it has no other member, and then the component is null; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from gaugeline.llm.common import quoted, raw, stored
from gaugeline.operators.components import components

SEED = 42
#: Fingerprints in one tile, and in the pieces a tile pair is compared by.
TILE, PIECE = 1 << 17, 256
#: Tiles' worth of fingerprints that a task compares with one tile, and comparisons that are worth a task.
MEET, WORK = 4, 1 << 30
#: Population counts of the quarters, the highest bits first.
QUARTERS = ("q3", "q2", "q1", "q0")
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of all shingle hashes, as an unsigned number."""
    words = text.lower().split()  # bytes: only A-Z change, and only the six ASCII blanks separate
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, count, ones = xxhash.xxh64_intdigest, len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, count, CHUNK):
        hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(at + CHUNK, count))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All rows and columns, plus the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprints(raw(text)))


def counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters, one row per fingerprint."""
    return np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int16)


def forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest member of each node's group, for links between numbered nodes."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def links(one: np.ndarray, two: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two tiles, or within one: pairs of fingerprints.

    Each tile is ordered by its counts and cut into pieces; a pair of pieces whose ranges of counts are further apart
    than the radius is skipped.
    """
    parts = []
    for tile in (one,) if same else (one, two):
        c = counts(tile)
        order = np.lexsort((c[:, 2], c[:, 0]))
        tile, c = tile[order], c[order]
        cut = range(0, len(tile), PIECE)
        parts.append((tile, [c[i : i + PIECE].min(axis=0) for i in cut], [c[i : i + PIECE].max(axis=0) for i in cut]))
    (a, low_a, high_a), (b, low_b, high_b) = parts[0], parts[-1]
    low_b, high_b = np.array(low_b), np.array(high_b)
    every = a if same else np.concatenate([a, b])
    base, found, held = 0 if same else len(a), ([], []), 0
    for i in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_a[i] - high_b, low_b - high_a[i])).sum(axis=1)
        block = a[i * PIECE : (i + 1) * PIECE]
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            near = np.bitwise_count(block[:, None] ^ b[None, j * PIECE : (j + 1) * PIECE]) <= radius
            if same and i == j:
                near = np.triu(near, 1)
            if near.any():
                x, y = np.nonzero(near)
                # within the two pieces a forest is enough
                size = len(block)
                if same and i == j:
                    root = forest(x, y, size)
                    child = np.flatnonzero(root != np.arange(size))
                    x, y = child, root[child]
                    nodes = np.arange(size) + i * PIECE
                else:
                    width = min(PIECE, len(b) - j * PIECE)
                    root = forest(x, y + size, size + width)
                    child = np.flatnonzero(root != np.arange(size + width))
                    x, y = child, root[child]
                    nodes = np.concatenate([np.arange(size) + i * PIECE, base + j * PIECE + np.arange(width)])
                found[0].append(nodes[x])
                found[1].append(nodes[y])
                held += len(x)
        if held > 4 * len(every):  # a forest of what was found so far holds less than that
            root = forest(np.concatenate(found[0]), np.concatenate(found[1]), len(every))
            child = np.flatnonzero(root != np.arange(len(every)))
            found, held = ([child], [root[child]]), len(child)
    if not found[0]:
        return a[:0], a[:0]
    root = forest(np.concatenate(found[0]), np.concatenate(found[1]), len(every))
    child = np.flatnonzero(root != np.arange(len(every)))
    return every[child], every[root[child]]


def tiled(prints: DataFrame) -> DataFrame:
    """The tiles of a table of different fingerprints: number, place, size, bounds of the quarters' counts, and the bytes.

    A cell holds equal counts of both halves. A cell of more than a tile is cut along its quarters' counts, so that
    its tiles differ in them; only what shares all four counts is dealt by hash.
    """
    signed = F.col("fingerprint")
    quarters = [F.bit_count(F.shiftrightunsigned(signed, 16 * k).bitwiseAND(F.lit(0xFFFF))).alias(f"q{k}") for k in (3, 2, 1, 0)]
    counted = prints.select(signed, *quarters)
    cell = Window.partitionBy("high", "low")
    total, before = F.sum("n").over(cell), F.sum("n").over(cell.orderBy("q3", "q1")) - F.col("n")
    # 17 x 17 x 17 x 17 rows at most
    cells = stored(
        counted.groupBy(*QUARTERS).agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"high": F.col("q3") + F.col("q2"), "low": F.col("q1") + F.col("q0")})
        .withColumns({"total": total, "before": before, "cuts": F.ceil(total / TILE)}),
        "simhash-cells",
    )
    cut = counted.join(F.broadcast(cells), list(QUARTERS)).withColumn("cut", F.expr("(before + pmod(xxhash64(fingerprint, 7), n)) * cuts div total"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        first, values = frame.iloc[0], np.sort(frame["fingerprint"].to_numpy())
        c = counts(values.view(np.uint64)).astype(np.int32)
        return pd.DataFrame({
            "high": [first["high"]], "low": [first["low"]], "cut": [first["cut"]], "size": [len(values)],
            "least": [c.min(axis=0)], "most": [c.max(axis=0)], "prints": [values.tobytes()],
        })

    kinds = "high int, low int, cut long, size long, least array<int>, most array<int>, prints binary"
    made = cut.select("high", "low", "cut", "fingerprint").groupBy("high", "low", "cut").applyInPandas(packed, kinds)
    # numbers follow the order of (high, low, cut)
    return stored(made.withColumn("tile", F.expr("(high * 64 + low) * (1L << 40) + cut")), "simhash-tiles")


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(tile, other, part, work) for all tiles that may hold near fingerprints, by numbers alone.

    A tile meets its own cell and the cells after it whose counts differ by no more than the radius in sum, there only
    tiles whose quarters' counts come as near. Its partners are dealt into parts of a bounded number of fingerprints.
    """
    near = [(h, w) for h in range(-radius, radius + 1) for w in range(-radius, radius + 1) if abs(h) + abs(w) <= radius and (h, w) >= (0, 0)]
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in near])
    index = tiles.select("tile", "high", "low", "size", "least", "most")
    asked = index.select(F.explode(steps).alias("d"), "*").select(
        (F.col("high") + F.col("d.h")).alias("high"), (F.col("low") + F.col("d.w")).alias("low"),
        F.col("tile").alias("other"), F.col("size").alias("others"), F.col("least").alias("other_least"), F.col("most").alias("other_most"),
    )
    gap = sum((F.greatest(F.lit(0), F.col("least")[k] - F.col("other_most")[k], F.col("other_least")[k] - F.col("most")[k]) for k in range(4)), F.lit(0))
    met = asked.join(index, ["high", "low"]).where((F.col("other") <= F.col("tile")) & (gap <= radius))
    before = F.sum("others").over(Window.partitionBy("tile").orderBy("other")) - F.col("others")
    part = F.floor(before / (MEET * TILE))
    return stored(met.select("tile", "other", part.alias("part"), (F.col("size") * F.col("others")).alias("work")), "simhash-pairs")


def linked(prints: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that connect what lies within the radius, from a table of different fingerprints.

    What is paired is tile numbers. The bytes of a tile then travel once to each part of its partners' comparisons,
    and once to each part of its own.
    """
    tiles = tiled(prints)
    pairs = tile_pairs(tiles, radius)
    work, parts = pairs.agg(F.coalesce(F.sum(F.col("work").cast("double")), F.lit(0.0)), F.count_distinct("tile", "part")).first()
    own = pairs.groupBy("tile", "part").agg(F.max(F.col("other") == F.col("tile")).alias("same")).withColumn("from", F.col("tile"))
    others = pairs.where("other <> tile").select("tile", "part", F.lit(None).cast("boolean").alias("same"), F.col("other").alias("from"))
    sent = own.unionByName(others).join(tiles.select(F.col("tile").alias("from"), "prints"), "from")

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["same"].notna()
        tile, same = np.frombuffer(frame.loc[own, "prints"].iloc[0], np.uint64), bool(frame.loc[own, "same"].iloc[0])
        found = [links(tile, tile, radius, True)] if same else []
        found += [links(np.frombuffer(other, np.uint64), tile, radius, False) for other in frame.loc[~own, "prints"]]
        u, v = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        return pd.DataFrame({"u": u, "v": v})

    tasks = int(max(1, min(parts, work // WORK + 1)))
    return sent.select("tile", "part", "same", "prints").repartition(tasks, "tile", "part").groupBy("tile", "part").applyInPandas(compared, "u long, v long")


def rooted_prints(prints: DataFrame, radius: int) -> DataFrame:
    """Different fingerprints, with further columns, get the root fingerprint of their group."""
    held = stored(prints, "simhash-prints")
    roots = components(linked(held.select("fingerprint"), radius)).withColumnRenamed("u", "fingerprint")
    return held.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its group).

    Copies are one fingerprint from the first grouping on, so a heap of them meets only in the last join, which has
    one row for a fingerprint on its other side and can be split.
    """
    marked = stored(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle).select("doc_id", "fingerprint"), "simhash")
    prints = rooted_prints(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), radius)
    smallest = prints.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(prints.join(smallest, "root").select("fingerprint", "component_id"), "simhash-components")
    return marked.join(named, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with one row left of each group: the smallest doc_id (null last), then the smallest text hash."""
    names = docs.columns
    rows = docs.select(F.struct(*map(quoted, names)).alias("doc"), F.col(text).alias("text"), F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"))
    marked = with_fingerprints(rows, shingle).select("doc", "id", "row", F.xxhash64("text").alias("text_hash"), "fingerprint")
    marked = stored(marked, "simhash-docs")  # from here on a row's number is what was written
    order = F.struct(F.col("id").isNull(), "id", "text_hash", "row")
    prints = rooted_prints(marked.groupBy("fingerprint").agg(F.min(order).alias("first")), radius)
    first = prints.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return marked.join(first, "row", "left_semi").select("doc.*")
