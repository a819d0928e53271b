"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are put into one order, rare ones first; the first three are its prefix. Of these, dynamic
programming chooses two that do not overlap and are rarest together: the pivots. One edit leaves at least one pivot
whole, so of two words one edit apart, one has a pivot that stands in the other's prefix, shifted by a place at most.
The edit also leaves the first or the last half of the shorter word as it is. An index entry is therefore a gram, its
place, the other word's length and a hash of the half that stays; entries of pivots are joined with entries of prefixes,
and what meets is verified. Halves in the entry keep lists short where many words share their rarest grams.

Occurrences are counted with partial counts, so a frequent word is one row of each task. Gram frequencies are at most
(26 + 64) ** 2 numbers, whatever the input; they alone go through the driver.

Defined results: null texts have no words; a null ``doc_id`` is an empty name in the hash; repeated rows are counted
each; long runs are words as others; equal counts are settled by code points; an empty table gives no rows. Other columns
are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.llm.common import folded, stored

GRAM = 2


def words(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and its occurrences ``n``, over whole texts.

    Of a run whose CRC-32 with the document's id is a multiple of ``every``, one code point is deleted first.
    """
    found = F.regexp_extract_all(folded(F.col(text)), F.lit(f"[a-z\\u00C0-\\u00FF]{{{shortest},}}+"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, short).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def gram_order(vocabulary: DataFrame) -> dict[str, tuple[int, str]]:
    """The order of all grams: by the number of their places in the vocabulary, then by text."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch["word"]:
                counts.update(word[i : i + GRAM] for i in range(len(word) - GRAM + 1))
        if counts:
            yield pd.DataFrame({"gram": list(counts.keys()), "n": list(counts.values())})

    counts = vocabulary.select("word").mapInPandas(tally, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {row["gram"]: (row["n"], row["gram"]) for row in counts.collect()}  # a row for two letters of the alphabet, at most


def prefix(word: str, order: dict[str, tuple[int, str]], edits: int = 1) -> list[int]:
    """Places of the word's first grams in the order; equal grams from left to right."""
    places = sorted(range(len(word) - GRAM + 1), key=lambda i: (order[word[i : i + GRAM]], i))
    return places[: GRAM * edits + 1]


def pivots(places: list[int], cost: list[int], edits: int = 1) -> list[int]:
    """The places of ``edits + 1`` grams that do not overlap, of least cost together.

    ``best[j]`` holds, for the places so far, the cheapest choice of ``j`` of them; a place takes its choice of one less
    from the places that end before it.
    """
    ordered = sorted(zip(places, cost, strict=True))
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * (edits + 1)]
    for i, (place, price) in enumerate(ordered):
        before = sum(p <= place - GRAM for p, _ in ordered[:i])
        row = list(best[i])
        for j in range(1, edits + 2):
            if (rest := best[before][j - 1]) and (row[j] is None or rest[0] + price < row[j][0]):
                row[j] = (rest[0] + price, [*rest[1], place])
        best.append(row)
    chosen = best[-1][edits + 1]
    assert chosen is not None, "a prefix always holds so many grams that do not overlap"
    return chosen[1]


def _entry(first: bool, gram: str, place: int, size: int, half: str) -> int:
    """64 bits that stand for an entry; what meets by chance is refused by verification."""
    return xxhash.xxh64_intdigest(f"{'<' if first else '>'}{gram}{place},{size},{half}") - 2**63


def prefix_entries(word: str, order: dict[str, tuple[int, str]]) -> set[int]:
    """The entries under which a word is found: its prefix grams with each half that an edit may leave."""
    size = len(word)
    halves = {size // 2, (size - 1) // 2}  # of the shorter word: this one, or one that is shorter
    return {
        _entry(first, word[p : p + GRAM], p, size, word[:h] if first else word[size - h :])
        for p in prefix(word, order) for h in halves for first in (True, False)
    }


def pivot_entries(word: str, order: dict[str, tuple[int, str]]) -> set[int]:
    """The entries under which a word looks for others: its pivots where one edit may put them."""
    size, out = len(word), set()
    places = prefix(word, order)
    for p in pivots(places, [order[word[i : i + GRAM]][0] for i in places]):
        gram = word[p : p + GRAM]
        for grown in (-1, 0, 1):
            h = min(size, size + grown) // 2
            # left of the edit nothing moves, right of it all moves by what the word has grown
            for shift in {0} if p + GRAM <= h else {0, grown}:
                out.add(_entry(True, gram, p + shift, size + grown, word[:h]))
            for shift in {grown} if p >= size - h else {0, grown}:
                out.add(_entry(False, gram, p + shift, size + grown, word[size - h :]))
    return out


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """All (word, n, near, near_n) with words that differ by one inserted, deleted or replaced code point, both ways round.

    ``vocabulary`` has different words of three letters at least, and their counts; it is read three times and should be stored.
    """
    order = gram_order(vocabulary)

    def entries(of) -> DataFrame:
        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = [list(of(word, order)) for word in batch["word"]]
                yield batch.assign(entry=keys).explode("entry").astype({"entry": "int64"})[["entry", "word", "n"]]

        return vocabulary.select("word", "n").mapInPandas(listed, "entry long, word string, n long")

    found, looking = entries(prefix_entries).alias("f"), entries(pivot_entries).alias("l")
    other_word = F.col("l.word") != F.col("f.word")  # first: a word meets itself, and a long one is dear to compare
    met = looking.join(found, "entry").where(F.when(other_word, F.levenshtein("l.word", "f.word", 1) == 1))
    one = met.select("l.word", "l.n", F.col("f.word").alias("near"), F.col("f.n").alias("near_n")).distinct()
    other = one.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return one.unionByName(other).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. ``forms`` has a row (word, form) for each word with a form, without cycles.

    Every round doubles the steps taken, so chains of any length take few rounds; each is written, not kept as lineage.
    """
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("jumped"))
        jumped = stored(jumped, "roots")
        reached = jumped.drop("jumped")
        if jumped.where("jumped").isEmpty():
            return reached


def grouped(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word.

    The form is the near word of largest count, if that is ``ratio`` times the word's at least.
    """
    held = stored(vocabulary, "words")
    best = near_pairs(held).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"),
    )
    enough: Column = -F.col("best.less") >= F.col("n") * ratio
    near = stored(best.select(
        "word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "near")
    followed = roots(near.where("form IS NOT NULL").select("word", "form"))
    return held.join(near, "word", "left").join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """The words of documents with the forms and roots they are spelling variants of."""
    return grouped(words(docs, shortest, least), ratio)
