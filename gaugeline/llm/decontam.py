"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the benchmark's windows of words. For each window length, the last two words under the search position
say how far it may safely move on; only where that is nought are the strings whose last two words these are compared in
full. Benchmarks are cut into blocks of bounded size, written once and sent to the executors; a worker takes a round of
whole texts, splits them once and searches them for one block after the other, so it holds the tables of a single block
however large the benchmark is, and no word pair is ever shuffled.

Defined cases: null or wordless texts have no words and are clean; items without words hold no window; items of a null
item_id are searched for and hit words, but are not counted or named; repeated item_ids count once; repeated documents
give repeated rows; an empty benchmark leaves every document clean. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.llm.common import quoted, raw, stored
from gaugeline.session import work_dir

#: Bytes of benchmark text that are searched for at once; their tables take some fifty times as much in a worker.
BLOCK_BYTES = 2 << 20
#: Blocks that one Python stage goes through before the rows are written out and the blocks given up.
CHAINED = 32
#: Bytes of text, and different words in them, after which a round of texts is searched.
ROUND_BYTES, ROUND_WORDS = 64 << 20, 1 << 20
#: 0-9, a-z and everything beyond ASCII make words; A-Z become a-z; the rest separates.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Search:
    """Shift and bucket tables for the windows of some items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        strings: dict[int, dict[tuple[int, ...], tuple | set]] = defaultdict(dict)
        shifts: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        for item, text in items:
            codes = [self.numbers.setdefault(w, len(self.numbers)) for w in words(text)]
            if not codes:
                continue
            size, named = min(window, len(codes)), () if item is None else (item,)
            block, own, safe = min(2, size), strings[size], shifts[size]
            for i in range(len(codes) - size + 1):
                string = tuple(codes[i : i + size])
                owners = own.setdefault(string, named)
                if isinstance(owners, set):
                    owners.update(named)
                elif owners != named:
                    own[string] = {*owners, *named}
            # The nearest end of a window at or after a block: its own, but for the first blocks of an item.
            for end in range(block, len(codes) + 1):
                key = tuple(codes[end - block : end])
                safe[key] = min(safe.get(key, size), max(0, size - end))
        self.tables = []
        for size, found in sorted(strings.items()):
            block = min(2, size)
            buckets: dict[tuple[int, ...], list[tuple[tuple[int, ...], tuple | set]]] = defaultdict(list)
            for string, owners in found.items():
                buckets[string[size - block :]].append((string, owners))
            self.tables.append((size, block, shifts[size], dict(buckets)))

    def find(self, codes: list[int], mark: Callable[[int, int], None]) -> set[str]:
        """Report the word places of every occurrence; the items they belong to."""
        items, end = set(), len(codes)
        for size, block, shifts, buckets in self.tables:
            beyond, at = size - block + 1, size
            while at <= end:
                key = tuple(codes[at - block : at])
                shift = shifts.get(key, beyond)
                if shift:
                    at += shift
                    continue
                here = tuple(codes[at - size : at])
                for string, owners in buckets[key]:
                    if string == here:
                        mark(at - size, at)
                        items.update(owners)
                at += 1
        return items


_built: list[tuple[list, int, Search]] = []


def search_for(block: list, window: int) -> Search:
    """The tables of a block; a worker keeps those of one block, so that a single block is built once."""
    for known, size, search in _built:
        if known is block and size == window:
            return search
    _built.clear()
    _built.append((block, window, Search(block, window)))
    return _built[0][2]


class Round:
    """Whole texts that are searched for one block after the other: words as numbers, and what was found in them."""

    def __init__(self):
        self.known: dict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.texts: list[np.ndarray] = []
        self.hits: dict[int, bytearray] = {}
        self.items: dict[int, set[str]] = defaultdict(set)
        self.size = 0

    def add(self, text: bytes, spans, items) -> None:
        """One more text, with the spans and items found before."""
        split, k = words(text), len(self.texts)
        self.texts.append(np.fromiter(map(self.known.__getitem__, split), np.int32, len(split)))
        self.size += len(text)
        for a, b in zip(spans[::2], spans[1::2], strict=True) if spans is not None else ():
            self.mark(k, a, b)
        if items is not None:
            self.items[k].update(items)

    def mark(self, k: int, start: int, end: int) -> None:
        hit = self.hits.get(k)
        if hit is None:
            hit = self.hits[k] = bytearray(len(self.texts[k]))
        hit[start:end] = b"\1" * (end - start)

    @property
    def full(self) -> bool:
        return self.size >= ROUND_BYTES or len(self.known) >= ROUND_WORDS

    def search(self, table: Search) -> None:
        own = np.fromiter((table.numbers.get(w, -1) for w in self.known), np.int32, len(self.known))
        for k, text in enumerate(self.texts):
            items = table.find(own[text].tolist(), partial(self.mark, k))
            if items:
                self.items[k] |= items

    def found(self) -> pd.DataFrame:
        rows = []
        for k, text in enumerate(self.texts):
            hit = self.hits.get(k)
            edges = [] if hit is None else np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(hit) + b"\0", np.int8))).tolist()
            rows.append((len(text), edges, sorted(self.items.get(k, ()))))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple[str | None, bytes]]]]:
    """The number of blocks of about the given size that the benchmark's items make, and the blocks, one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), raw(text).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-size // limit))
    taken = lambda part: [(r["item"], bytes(r["text"])) for r in part.select("item", "text").collect()]
    if number == 1:
        return 1, iter([taken(items)])
    path, cut = work_dir(spark, "benchmark"), items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(number)))
    cut.repartition("block").write.partitionBy("block").parquet(path)
    held = spark.read.schema(cut.schema).parquet(path)
    return number, (taken(held.where(F.col("block") == k)) for k in range(number))


def scan(sent: list[Broadcast], window: int):
    """A function of texts and what was found in them so far, for some blocks of items."""

    @F.pandas_udf("n_words long, spans array<long>, items array<string>")
    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        def searched(texts: Round) -> pd.DataFrame:
            for block in sent:
                texts.search(search_for(block.value, window))
            return texts.found()

        held = Round()
        for contents, before in batches:
            for content, spans, items in zip(contents, before["spans"], before["items"], strict=True):
                held.add(content, spans, items)
                if held.full:
                    yield searched(held)
                    held = Round()
        if held.texts:
            yield searched(held)

    return search


def searched(rows: DataFrame, benchmark: DataFrame, item_id: str = "item_id", window: int = 13, limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows with a column ``text``, plus ``found``: n_words, spans of hit words (start, end, start, end ...) and the items that occur.

    A benchmark of one block makes a plan; of a larger one, every stage's rows are written and its blocks destroyed.
    """
    context = rows.sparkSession.sparkContext
    rows = rows.withColumn("found", F.lit(None).cast("struct<n_words:long, spans:array<long>, items:array<string>>"))
    number, parts = blocks(benchmark, item_id, "text", limit)
    while sent := [context.broadcast(part) for part in islice(parts, CHAINED)]:
        rows = rows.withColumn("found", scan(sent, window)(raw("text"), F.col("found")))
        if number > 1:
            rows = stored(rows, "decontamination")
            for block in sent:
                block.destroy()
    return rows


def hit_words(spans: Column) -> Column:
    """The number of words in spans: ends less starts."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Any hit, and a twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    f = F.col("found")
    rows = searched(rows, items, window=window).select(
        "doc_id", f["n_words"].alias("n_words"), hit_words(f["spans"]).alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), f["items"].alias("items"), f["spans"].alias("spans"),
    )
    return rows.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = 13) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), quoted(text).alias("text"))
    rows = searched(rows, benchmark.select(benchmark[item_id].alias("item_id"), benchmark[text].alias("text")), window=window)
    return rows.where(~is_contaminated(hit_words(F.col("found.spans")), F.col("found.n_words"))).select("doc.*")
