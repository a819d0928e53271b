"""Line dedup by site-relative frequency.

A line of a site is boilerplate if more than a given share of the site's pages contain it, and at least a given number
of pages. Only 64-bit hashes of lines are grouped, partial counts first, so a site of a third of all rows is counted by
all tasks. At most (lines per page / share) lines of a site can pass, so a site's list is short; it joins the pages by
site and the lines are dropped within the row.

Defined cases: lines are what lies between line feeds, compared without white space at their ends; lines of white space
alone are kept and never counted; a null text stays null and counts as a page; a null site is a site of its own; a line
counts once per page; repeated rows are pages each; a page all of whose lines go keeps an empty text. With ``once``, equal
texts of a site are one page together, in what holds a line and in the total, so copies of a text make no line of it
boilerplate; all copies lose the same lines. :func:`boilerplate_of_groups` does so for near copies, grouped by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.llm.common import quoted
from gaugeline.session import small_side

RATIO, PAGES = 0.1, 3
_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def bare(text: Column) -> Column:
    """The hashes of a text's lines, null for blank ones."""
    def identity(line: Column) -> Column:
        trimmed = F.regexp_replace(line, _ENDS, "")
        return F.when(trimmed != "", F.xxhash64(trimmed))

    return F.transform(F.split(text, "\n", -1), identity)


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = PAGES, once: bool = False) -> DataFrame:
    """(site, lines): the hashes of each site's boilerplate lines."""
    named = pages.select(F.col(site).alias("site"), F.col(text).alias("text"))
    each = F.array_distinct(bare(F.col("text")))
    if once:  # a task sends one row of hashes for all copies it has
        named = named.select("site", each.alias("each"), F.xxhash64("text").alias("text_hash")).dropDuplicates(["site", "text_hash"])
        each = F.col("each")
    return _frequent(named.select("site", F.explode(each).alias("line")).where("line IS NOT NULL"), named, ratio, least)


def boilerplate_of_groups(pages: DataFrame, site: str, hashes: str, group: str, ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """(site, lines) like :func:`boilerplate`, with all pages of a group counted as one; ``hashes`` are the pages' lines by :func:`bare`.

    A line counts once for each group of the site that has it, in whichever of its pages.
    """
    named = pages.select(F.col(site).alias("site"), F.col(group).alias("group"), F.col(hashes).alias("hashes"))
    held = named.select("site", "group", F.explode("hashes").alias("line")).where("line IS NOT NULL").distinct()
    return _frequent(held, named.select("site", "group").distinct(), ratio, least)


def _frequent(held: DataFrame, pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """(site, lines) from a row for each line of a page, and a row for each page."""
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counted = held.groupBy("site", "line").agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= least)
    joined = counted.alias("c").join(totals.alias("t"), F.col("c.site").eqNullSafe(F.col("t.site")))
    frequent = joined.where(F.col("holding") > F.col("pages") * F.lit(ratio))
    return frequent.groupBy(F.col("c.site").alias("site")).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, site: str, text: str = "text", ratio: float = RATIO, least: int = PAGES, counts: bool = False, once: bool = False, listed: DataFrame | None = None) -> DataFrame:
    """All rows and columns with the text's boilerplate lines left out; with ``counts``, a struct of lines and dropped lines too.

    ``listed`` may give the lines of the sites, as (site, lines).
    """
    names = pages.columns
    found = boilerplate(pages, site, text, ratio, least, once) if listed is None else listed
    listed = small_side(found)  # measured: where it is small, no text is shuffled
    rows = pages.select(F.struct(*map(quoted, names)).alias("page"), quoted(site).alias("site"), quoted(text).alias("text"))
    rows = rows.alias("p").join(listed.alias("b"), F.col("p.site").eqNullSafe(F.col("b.site")), "left").select("page", "text", "lines")
    split = rows.withColumn("parts", F.split("text", "\n", -1)).withColumn("hashes", F.when(F.col("lines").isNotNull(), bare(F.col("text"))))
    kept = F.when(
        F.col("lines").isNotNull(),
        F.filter("parts", lambda line, i: ~F.coalesce(F.array_contains(F.col("lines"), F.get("hashes", i)), F.lit(False))),
    ).otherwise(F.col("parts"))
    done = split.select("page", F.col("parts"), kept.alias("kept"))
    fields = [F.concat_ws("\n", "kept") if c == text else F.col("page")[c] for c in names]
    fields = [F.when(F.col("parts").isNotNull(), f).alias(c) if c == text else f.alias(c) for f, c in zip(fields, names, strict=True)]
    if counts:
        size = F.coalesce(F.size("parts"), F.lit(0))
        fields.append(F.struct(F.greatest(size, F.lit(0)).cast("long").alias("n_lines"), F.greatest(size - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped")).alias("_lines"))
    return done.select(*fields)


def line_dedup(docs: DataFrame, site: str = "source", doc_id: str = "doc_id", text: str = "text", ratio: float = RATIO, least: int = PAGES, once: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and the text that is left."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).alias("site"), F.col(text).alias("text"))
    return drop_boilerplate(rows, "site", "text", ratio, least, counts=True, once=once).select("doc_id", "_lines.n_lines", "_lines.n_dropped", "text")
