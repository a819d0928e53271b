"""Exposition text to samples.

A scrape is one row of text, and everything about it (types, filters, cap) is decided inside
that row with array functions; only then is it exploded. Ingest therefore needs no shuffle at
all, and the body limit bounds the work on a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import float_text, is_plain_number

# Possessive repeats keep the matcher from recursing on long label blocks.
_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*+"
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_NUMBER = r"[+-]?(?:(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?|(?i:inf|infinity|nan))"
_LABEL = rf"[a-zA-Z_][a-zA-Z0-9_]*+\s*+=\s*+{_QUOTED}\s*+"
_BLOCK = rf"\{{(\s*+(?:{_LABEL}(?:,\s*+{_LABEL})*+(?:,\s*+)?+)?+)\}}"
_LOOSE = rf"\{{(?:[^\"}}]++|{_QUOTED})*+\}}"
_REST = rf"\s+({_NUMBER})(?:\s+-?[0-9]++)?"
SAMPLE = rf"^\s*({_NAME})\s*(?:{_BLOCK})?{_REST}\s*$"
# Why a line is no sample, tried in this order: the reason, and what its lines look like.
UNREAD = {
    "exemplar": rf"^\s*{_NAME}\s*(?:{_BLOCK})?{_REST}\s*+#",
    "labels": rf"^\s*{_NAME}\s*{_LOOSE}{_REST}\s*$|^\s*{_NAME}\s*\{{[^}}]*+$",
    "value": rf"^\s*{_NAME}\s*(?:{_BLOCK}\s*\S|\s\S++\s*$)",
}
TYPE = rf"^\s*#\s*TYPE\s+({_NAME})\s+(\w+)\s*$"
# A pair starts at a brace or comma: trying every letter of the name would cost far more.
PAIR = r'[{,]\s*([a-zA-Z_][a-zA-Z0-9_]*+)\s*=\s*"((?:[^"\\]++|\\.)*+)"'

# What a type is stored as; every other type counts as a counter.
GAUGE, COUNTER, HISTOGRAM, SUMMARY = "gauge", "counter", "histogram", "summary"
TARGET_LABEL = "scrape_target"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value once per row, so that a lambda using it does not compute it per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _lines(body: Column) -> Column:
    """Numbered lines. A carriage return stays on its line, where the patterns take it as space."""
    return F.transform(F.split(body, "\n"), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))


def _types(lines: Column) -> Column:
    """Family to its TYPE lines ``(line_no, kind)`` in line order, as a map."""
    hits = F.transform(
        F.filter(lines, lambda x: x["line"].contains("TYPE") & x["line"].rlike(TYPE)),
        lambda x: F.struct(
            F.regexp_extract(x["line"], TYPE, 1).alias("family"),
            F.struct(x["line_no"].alias("line_no"), F.regexp_extract(x["line"], TYPE, 2).alias("kind")).alias("at"),
        ),
    )

    def by_family(found: Column) -> Column:
        def grouped(families: Column) -> Column:
            one_each = F.transform(found, lambda t: F.array(t["at"]))
            repeated = F.transform(
                families, lambda f: F.transform(F.filter(found, lambda t: t["family"] == f), lambda t: t["at"])
            )
            return F.map_from_arrays(
                families, F.when(F.size(families) == F.size(found), one_each).otherwise(repeated)
            )

        return _let(F.array_distinct(F.transform(found, lambda t: t["family"])), grouped)

    return _let(hits, by_family)


def _kind_at(types: Column, family: Column, line_no: Column) -> Column:
    """Kind the last TYPE line of a family above a line gives, or null."""
    above = F.filter(types[family], lambda t: t["line_no"] < line_no)
    return F.when(F.size(above) > 0, F.element_at(above, -1)["kind"])


def parsed_samples(body: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Array of ``(line_no, line, name, family, kind)`` for the sample lines of a body.

    A ``x_bucket`` line belongs to family ``x`` if that is a histogram at this point, otherwise
    the line is a family of its own. ``kind`` is null without a TYPE line. ``wanted`` drops lines
    by their start before any pattern is tried on them.
    """

    def is_sample(x: Column) -> Column:
        plausible = ~x["line"].startswith("#")
        if wanted is not None:
            plausible = plausible & wanted(F.ltrim(x["line"]))
        return plausible & x["line"].rlike(SAMPLE)

    def named(x: Column) -> Column:
        name = F.regexp_extract(x["line"], _NAME, 0)
        return F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), name.alias("name"))

    def base(name: Column) -> Column:
        return F.substring(name, F.lit(1), F.length(name) - len("_bucket"))

    def classify(types: Column, x: Column) -> Column:
        own = _kind_at(types, x["name"], x["line_no"]).alias("own")
        of_base = F.when(x["name"].endswith("_bucket"), _kind_at(types, base(x["name"]), x["line_no"]))
        return F.struct(*[x[c].alias(c) for c in ("line_no", "line", "name")], own, (of_base == HISTOGRAM).alias("part"))

    def settle(x: Column) -> Column:
        return F.struct(
            *[x[c].alias(c) for c in ("line_no", "line", "name")],
            F.when(x["part"], base(x["name"])).otherwise(x["name"]).alias("family"),
            F.when(x["part"], F.lit(HISTOGRAM)).otherwise(x["own"]).alias("kind"),
        )

    def classified(lines: Column) -> Column:
        found = F.transform(F.filter(lines, is_sample), named)
        return _let(_types(lines), lambda types: F.transform(F.transform(found, lambda x: classify(types, x)), settle))

    return _let(_lines(body), classified)


def line_kinds(body: Column) -> Column:
    """Array of ``(line_no, kind, reason)`` for every line: blank, comment, sample or unread, the last with a reason."""

    def kind(line: Column) -> Column:
        bare = F.trim(F.replace(F.replace(line, F.lit("\r"), F.lit(" ")), F.lit("\t"), F.lit(" ")))
        return F.when(bare == "", "blank").when(bare.startswith("#"), "comment").when(line.rlike(SAMPLE), "sample").otherwise("unread")

    def reason(line: Column) -> Column:
        found = F.lit("line")
        for name, pattern in reversed(UNREAD.items()):
            found = F.when(line.rlike(pattern), name).otherwise(found)
        return found

    kinds = F.transform(_lines(body), lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), kind(x["line"]).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(
        x["line_no"].alias("line_no"), x["kind"].alias("kind"), F.when(x["kind"] == "unread", reason(x["line"])).alias("reason")))


def line_counts(kinds: Column) -> Column:
    """Struct of ``lines, blank, comments, samples, unread`` and the unread ones by reason, of :func:`line_kinds`."""

    def counts(found: Column) -> Column:
        def of(name: str) -> Column:
            return F.size(F.filter(found, lambda x: x["kind"] == name)).cast("bigint")

        def why(name: str) -> Column:
            return F.size(F.filter(found, lambda x: x["reason"] == name)).cast("bigint")

        return F.struct(
            F.size(found).cast("bigint").alias("lines"), of("blank").alias("blank"), of("comment").alias("comments"), of("sample").alias("samples"),
            of("unread").alias("unread"), *[why(name).alias(f"unread_{name}") for name in (*UNREAD, "line")],
        )

    return _let(kinds, counts)


def _unescape(text: Column) -> Column:
    marker = F.lit("\u0000")
    plain = F.replace(text, F.lit("\\\\"), marker)
    plain = F.replace(F.replace(plain, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, marker, F.lit("\\"))


def with_labels(samples: DataFrame) -> DataFrame:
    """Add ``labels`` of a valid sample ``line`` as a map; a repeated label keeps its last value.

    Keys and values are columns of their own first, so that the patterns run once per line.
    """
    found = samples.withColumns(
        {
            "_keys": F.regexp_extract_all("line", F.lit(PAIR), F.lit(1)),
            "_raw": F.regexp_extract_all("line", F.lit(PAIR), F.lit(2)),
        }
    )
    values = F.when(F.contains("line", F.lit("\\")), F.transform("_raw", _unescape)).otherwise(F.col("_raw"))

    def last_of_each(pairs: Column) -> Column:
        return F.filter(
            pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["keys"] == p["keys"])
        )

    repeated = _let(F.arrays_zip(F.col("_keys").alias("keys"), values.alias("values")), last_of_each)
    unique = F.size(F.array_distinct("_keys")) == F.size("_keys")
    labels = F.when(unique, F.map_from_arrays("_keys", values)).otherwise(F.map_from_entries(repeated))
    return found.withColumn("labels", labels).drop("_keys", "_raw")


def value_of(line: Column) -> Column:
    """Value of a valid sample line: the first word after the labels, or after the name."""
    rest = F.when(line.contains("}"), F.substring_index(line, "}", -1)).otherwise(F.regexp_replace(line, r"^\s*\S+", ""))
    return F.regexp_extract(rest, r"\S+", 0).try_cast("double")


def parse_exposition(payloads: DataFrame) -> DataFrame:
    """One row per sample line: the payload columns, ``line_no, family, kind, name, labels, value``."""
    others = [c for c in payloads.columns if c != "body"]
    # The outer form: Spark would put a filter on the array below the plain one, and parse twice.
    found = payloads.select(*others, F.inline_outer(parsed_samples(F.col("body").cast("string"))))
    rows = with_labels(found.filter(F.col("line_no").isNotNull()))
    return rows.select(*others, "line_no", "family", "kind", "name", "labels", value_of(F.col("line")).alias("value"))


def metric_type(kind: str | Column = "kind") -> Column:
    """Gauges stay gauges; everything else, untyped included, is stored as a counter."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == GAUGE, GAUGE).otherwise(COUNTER)


def _normalised(samples: DataFrame, key: str, applies: Column) -> DataFrame:
    # Most spellings are short already; only the others have their map rebuilt.
    rebuild = applies & ~is_plain_number(F.col("labels")[key])
    number = F.transform_values("labels", lambda k, v: F.when(k == key, float_text(v)).otherwise(v))
    return samples.withColumn("labels", F.when(rebuild, number).otherwise(F.col("labels")))


def decompose_histograms(samples: DataFrame) -> DataFrame:
    """Buckets of histograms: ``le`` in its shortest spelling. Sums and counts are plain samples."""
    return _normalised(samples, "le", (F.col("kind") == HISTOGRAM) & (F.col("name") != F.col("family")))


def decompose_summaries(samples: DataFrame) -> DataFrame:
    """Quantiles of summaries keep the base name, with ``quantile`` in its shortest spelling."""
    return _normalised(samples, "quantile", F.col("kind") == SUMMARY)


def inject_target(labels: Column, target: Column) -> Column:
    """Add the target label; one the scraped text brought along is replaced."""
    kept = F.map_filter(labels, lambda k, _: k != TARGET_LABEL)
    return F.map_concat(kept, F.create_map(F.lit(TARGET_LABEL), target))
