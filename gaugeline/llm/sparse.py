"""Repeated passages by a sparse suffix array.

Of all suffixes of all texts, only those at content-selected positions are kept: the places of the least hash among
every 25 runs of words. Any passage of 50 words holds such a place in its first half, the same one wherever the passage
stands, so suffixes that start there agree in their head of 26 words. Kept suffixes are sorted by head and neighbours
compared; heads of a single document go. What is left is sorted by its surroundings, 24 words to the left and 50 to the
right: where neighbours agree in them, the whole stretch is repeated. Only where equal heads have different surroundings
is the match extended word by word: all passages that this place selects are cut out, sorted and compared likewise.

So the result is exact: a word is covered if it lies in 50 consecutive words that another document has too (equal
64-bit hashes count as equal words). ``drop_later_copies`` removes what is found: of every such passage the occurrence of
the least (document id, place) stays.

Defined cases: words are what lies between ASCII white space, as written; null and shorter texts hold no passage; rows
of equal doc_id and text are one document, so they are no repetition of each other, and give one result; null ids are
carried; documents that merely share an id are different documents; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from gaugeline.llm.common import quoted, raw, row_key, stored
from gaugeline.llm.runs import shared_runs

BASE = 0x9E37_79B9_7F4A_7C15
MIX = 0xBF58_476D_1CE4_E5B9
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]).cumprod(dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit numbers."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(MIX)
    return x ^ x >> np.uint64(29)


class Words:
    """Hashes of any run of words of a text, modulo 2^64."""

    def __init__(self, text: bytes):
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w) for w in text.split()], np.uint64)
        self.n = len(hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), (hashes * powers(BASE, self.n)).cumsum(dtype=np.uint64)])
        self.back = powers(pow(BASE, -1, 1 << 64), self.n + 1)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def selected(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that passages of ``least`` words select, and the heads that stand there."""
    spread = least // 2
    head = least - spread + 1
    if words.n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(words.n - head + 1)
    heads = words.runs(at, at + head)
    views = np.lib.stride_tricks.sliding_window_view(heads, spread)
    chosen = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return chosen, heads[chosen]


def suffixes(docs: DataFrame, least: int) -> DataFrame:
    """(head, around, owner, doc_id, place, start, end) of the kept suffixes; start and end bound their surroundings."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for owner, doc, text in zip(batch["owner"], batch["doc_id"], batch["text"], strict=True):
                words = Words(text)
                place, heads = selected(words, least)
                if not len(place):
                    continue
                start, end = np.maximum(0, place - least // 2 + 1), np.minimum(words.n, place + least)
                shape = mixed(((place - start) * 1024 + (end - place)).astype(np.uint64) + np.uint64(1))
                around = mixed(words.runs(start, end) ^ shape)
                parts.append(pd.DataFrame({
                    "head": heads.view(np.int64), "around": around.view(np.int64), "owner": owner, "doc_id": pd.array([doc] * len(place), "Int64"),
                    "place": place.astype(np.int32), "start": start.astype(np.int32), "end": end.astype(np.int32),
                }))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return docs.mapInPandas(kept, "head long, around long, owner long, doc_id long, place int, start int, end int")


def passages(docs: DataFrame, least: int) -> DataFrame:
    """(passage, owner, doc_id, start): the passages that the given places of each document select."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for owner, doc, text, places in zip(batch["owner"], batch["doc_id"], batch["text"], batch["places"], strict=True):
                words = Words(text)
                start = np.unique((np.array(places, np.int64)[:, None] - np.arange(least // 2)).ravel())
                start = start[(start >= 0) & (start <= words.n - least)]
                parts.append(pd.DataFrame({
                    "passage": words.runs(start, start + least).view(np.int64), "owner": owner,
                    "doc_id": pd.array([doc] * len(start), "Int64"), "start": start.astype(np.int32),
                }))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return docs.mapInPandas(cut, "passage long, owner long, doc_id long, start int")


def merged_spans(spans):
    """Spans (start, end) joined where they touch or overlap.

    Starts and ends are sorted on their own; a stretch ends where the next start lies beyond the end of the same rank.
    """
    def joined(pair):
        starts, ends = pair["starts"], pair["ends"]
        breaks = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > F.get(ends, i)))
        return F.transform(breaks, lambda i, k: F.struct(
            F.get(starts, F.when(k == 0, F.lit(0)).otherwise(F.get(breaks, k - 1) + 1)).alias("start"), F.get(ends, i).alias("end"),
        ))

    both = F.struct(F.array_sort(F.transform(spans, lambda s: s["start"])).alias("starts"), F.array_sort(F.transform(spans, lambda s: s["end"])).alias("ends"))
    return F.element_at(F.transform(F.array(both), joined), 1)


def stretches(rows: DataFrame, least: int) -> DataFrame:
    """owner, doc_id, spans: the stretches of each document, out of rows (doc_id, text, owner)."""
    kept = stored(suffixes(rows, least), "suffixes")
    candidates = stored(shared_runs(kept, "head", "owner"), "candidates")
    around = shared_runs(candidates, "around", "owner", alone=True)
    whole, differing = around.where(F.col("shared") & (F.col("end") - F.col("start") >= least)), around.where("NOT shared")
    # Two owners of each kind of repeated surroundings stand for all, where others of its head differ.
    unlike = differing.select("head").distinct()
    kinds = whole.groupBy("around", "head").agg(
        F.min("owner").alias("a"), F.min_by("place", "owner").alias("at_a"), F.max("owner").alias("b"), F.max_by("place", "owner").alias("at_b"),
    )
    both = F.array(*[F.struct(F.col(o).alias("owner"), F.col(p).alias("place")) for o, p in (("a", "at_a"), ("b", "at_b"))])
    stands = kinds.join(unlike, "head", "left_semi").select(F.inline(both))
    places = differing.select("owner", "place").unionByName(stands).groupBy("owner").agg(F.collect_set("place").alias("places"))
    extended = stored(passages(rows.join(places, "owner"), least), "passages")
    found = shared_runs(extended, "passage", "owner").select("owner", "doc_id", "start", (F.col("start") + least).alias("end"))
    spans = whole.select("owner", "doc_id", "start", "end").unionByName(found)
    return spans.groupBy("owner", "doc_id").agg(merged_spans(F.collect_set(F.struct("start", "end"))).alias("spans"))


def repeated_passages(docs: DataFrame, least: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end, n_words: stretches of words that lie in passages of ``least`` words other documents have too.

    Documents without such a stretch have no row.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw(text).alias("text")).withColumn("owner", row_key("doc_id", "text"))
    found = stretches(rows, least).select("doc_id", F.explode("spans").alias("s"))
    return found.select("doc_id", "s.start", "s.end", (F.col("s.end") - F.col("s.start")).cast("long").alias("n_words"))


def passages_of_spans(docs: DataFrame, least: int) -> DataFrame:
    """(passage, doc_id, owner, start): every passage inside the spans of each document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for owner, doc, text, spans in zip(batch["owner"], batch["doc_id"], batch["text"], batch["spans"], strict=True):
                words = Words(text)
                start = np.concatenate([np.arange(x["start"], x["end"] - least + 1) for x in spans])
                yield pd.DataFrame({
                    "passage": words.runs(start, start + least).view(np.int64), "doc_id": pd.array([doc] * len(start), "Int64"),
                    "owner": owner, "start": start.astype(np.int32),
                })

    return docs.mapInPandas(cut, "passage long, doc_id long, owner long, start int")


def later_occurrences(occurrences: DataFrame) -> DataFrame:
    """(owner, start) of all occurrences of a passage but its first, by (doc_id, owner, start), null ids first.

    Occurrences are sorted by range over all of these, so a frequent passage is spread over many partitions. The first
    row of a partition is later if its passage stands in the partition before, whose last row tells: two rows of each
    partition are compared.
    """

    def flagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = held = None
        for batch in batches:
            if not len(batch):
                continue
            key = batch["passage"].to_numpy()
            first = np.concatenate([[before is None or key[0] != before], key[1:] != key[:-1]])
            edge = np.zeros(len(batch), bool)
            edge[0] = before is None
            before, batch = key[-1], batch.assign(first=first, edge=edge)
            if held is not None:
                yield held
            held = batch
        if held is not None:
            held.loc[held.index[-1], "edge"] = True
            yield held

    order = ["passage", "doc_id", "owner", "start"]
    ordered = occurrences.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = stored(ordered.mapInPandas(flagged, "passage long, doc_id long, owner long, start int, first boolean, edge boolean"), "occurrences")
    place = F.struct(*order[1:])
    least = marked.where("edge").groupBy("passage").agg(F.min(place).alias("least"))
    goes_on = marked.where("first AND edge").join(F.broadcast(least), "passage").where(place > F.col("least"))
    return marked.where("NOT first").select("owner", "start").unionByName(goes_on.select("owner", "start"))


@F.pandas_udf(StringType())
def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of the spans and the white space after them; null where there are no spans."""
    out: list[str | None] = []
    for text, cuts in zip(texts, spans, strict=True):
        if not len(cuts):
            out.append(None)
            continue
        place = [m.start() for m in _WORD.finditer(text)] + [len(text)]
        kept, at = [], 0
        for cut in cuts:
            kept.append(text[at : place[cut["start"]]])
            at = place[cut["end"]]
        out.append(b"".join([*kept, text[at:]]).decode())
    return pd.Series(out, dtype=object)


def drop_later_copies(docs: DataFrame, least: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents with all their columns; texts lose every later occurrence of a passage that several documents have.

    Each word that goes stands in an earlier occurrence, and no passage of ``least`` words is left in two documents in its
    old surroundings. Later occurrences in the document of the first go too. Texts that lose nothing stay as they are, null too.
    """
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), quoted(doc_id).cast("long").alias("doc_id"), raw(text).alias("text"))
    rows = rows.withColumn("owner", row_key("doc_id", "text"))
    found = stored(stretches(rows.select("doc_id", "text", "owner"), least).select("owner", "spans"), "stretches")
    once = rows.select("doc_id", "text", "owner").join(found.select("owner"), "owner", "left_semi").dropDuplicates(["owner"]).join(found, "owner")
    later = later_occurrences(stored(passages_of_spans(once, least), "occurrences"))
    cuts = later.groupBy("owner").agg(merged_spans(F.collect_set(F.struct("start", (F.col("start") + least).alias("end")))).alias("cuts"))
    rest = rows.join(cuts, "owner", "left")
    changed = without(F.col("text"), F.coalesce("cuts", F.array().cast(cuts.schema["cuts"].dataType)))
    return rest.withColumn("left", changed).select(*[
        (F.coalesce("left", F.col("doc")[c]) if c == text else F.col("doc")[c]).alias(c) for c in docs.columns
    ])
