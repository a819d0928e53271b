"""Packing along a space-filling curve.

A document's hashed vector of byte 4-grams is projected to three numbers; its place on a Hilbert curve through that
cube is the key of a range sort. Along the curve the documents' ids (each followed by an end id) run through the
sequences without a gap. What is left at the end of a partition is cut into sequences of powers of two, so no sequence
is padded at all. Range bounds include a hash of each row, so a heap of equal documents or repeated rows is spread over partitions.

Defined cases: null texts are empty, and a document of no ids is its end id alone; null ids are carried; repeated rows
are packed each; very long texts run through as many sequences as they need; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import raw
from gaugeline.llm.tokens import vocabulary

DIMENSIONS, BITS, BUCKETS = 3, 10, 1 << 10
#: Bytes of a text that are hashed at once.
SLICE = 1 << 20
#: Pieces that leave a task at once.
ROWS = 1024


def projection() -> np.ndarray:
    """One fixed direction for every bucket of the hashed vector."""
    return np.random.default_rng(20_240_601).standard_normal((BUCKETS, DIMENSIONS))


def project(text: bytes, directions: np.ndarray) -> np.ndarray:
    """The hashed vector of byte 4-grams, projected and brought to length one."""
    tally = np.zeros(BUCKETS)
    for at in range(0, max(1, len(text) - 3), SLICE):
        part = np.frombuffer(text[at : at + SLICE + 3], np.uint8).astype(np.uint32)
        if len(part) >= 4:
            grams = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
            tally += np.bincount((grams * np.uint32(2_654_435_761)) >> np.uint32(22), minlength=BUCKETS)
    vector = np.log1p(tally) @ directions
    length = np.sqrt(vector @ vector)
    return vector / length if length else vector


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve for points of whole numbers below 2^bits, one row each.

    The axes are turned into the curve's transposed digits, from the highest bit down, and the digits interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap if i else 0
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), top
    while bit > 1:
        flip ^= np.where(x[n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> bit & 1)
    return place


def pieces(documents: Iterator[tuple[object, np.ndarray]], size: int, first: int) -> Iterator[tuple]:
    """Cut a run of documents into sequences: (doc_id, start, ids, doc_tokens, sequence_id, offset)."""
    sequence, held, filled = first, [], 0
    for doc, ids in documents:
        start, total = 0, len(ids)
        while start < total:
            take = min(size - filled, total - start)
            held.append((doc, start, ids[start : start + take], total))
            start, filled = start + take, filled + take
            if filled == size:
                offset = 0
                for d, s, part, n in held:
                    yield d, s, part, n, sequence, offset
                    offset += len(part)
                sequence, held, filled = sequence + 1, [], 0
    # the rest: one sequence for each power of two in its length
    room, offset = 1 << (filled.bit_length() - 1) if filled else 0, 0
    for d, s, part, n in held:
        while len(part):
            take = min(room - offset, len(part))
            yield d, s, part[:take], n, sequence, offset
            s, part, offset, filled = s + take, part[take:], offset + take, filled - take
            if offset == room and filled:
                sequence, offset, room = sequence + 1, 0, 1 << (filled.bit_length() - 1)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids."""
    if size < 1 or size & (size - 1):
        raise ValueError("the sequence length must be a power of two")

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        directions, top = projection(), (1 << BITS) - 1
        for texts in batches:
            points = np.array([project(t, directions) for t in texts]).reshape(-1, DIMENSIONS)
            yield pd.Series(hilbert(np.rint((points + 1) / 2 * top).clip(0, top), BITS))

    placed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("place", place(raw()))
    placed = placed.withColumn("tie", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()))  # sets repeated rows apart
    sorted_docs = placed.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie", "doc_id")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = vocabulary(path), np.array([end_id], "<u4")

        def documents() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    yield None if pd.isna(doc) else int(doc), np.concatenate([words.text_ids(text), end])

        rows: list[tuple] = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame({
                "doc_id": pd.array([r[0] for r in rows], "Int64"), "start": [r[1] for r in rows], "length": [len(r[2]) for r in rows],
                "ids_crc32": [zlib.crc32(r[2].tobytes()) for r in rows], "doc_tokens": [r[3] for r in rows],
                "sequence_id": [r[4] for r in rows], "offset": [r[5] for r in rows],
            })
            return out.assign(ids=[r[2].astype(np.int32) for r in rows]) if with_ids else out

        for row in pieces(documents(), size, TaskContext.get().partitionId() << 32):
            rows.append(row)
            if len(rows) == ROWS:
                yield frame()
                rows.clear()
        if rows:
            yield frame()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return sorted_docs.select("doc_id", "text").mapInPandas(packed, schema + (", ids array<int>" if with_ids else ""))
