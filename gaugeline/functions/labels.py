"""Label access: JSON text in cold tables, maps after ingest, promoted columns where present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Labels that ingest stores as columns of their own.
PROMOTED = ("path", "status", "scrape_target", "region")
UNKNOWN = "(unknown)"


def label(key: str, labels: str | Column = "labels") -> Column:
    """One label out of the JSON text; keys with dots or spaces work too."""
    column = F.col(labels) if isinstance(labels, str) else labels
    if "'" in key:
        return F.from_json(column, "map<string,string>")[key]
    return F.get_json_object(column, f"$['{key}']")


def label_of(df: DataFrame, key: str) -> Column:
    """The promoted column if the table has it, else a lookup in ``labels``."""
    if key in PROMOTED and key in df.columns:
        return F.col(key)
    if dict(df.dtypes).get("labels", "string").startswith("map"):
        return F.col("labels")[key]
    return label(key)


def or_unknown(column: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(UNKNOWN))


def labels_map(labels: str | Column = "labels") -> Column:
    return F.from_json(F.col(labels) if isinstance(labels, str) else labels, "map<string,string>")


def sorted_pairs(labels: Column) -> Column:
    """Label pairs sorted by key."""
    return F.sort_array(F.map_entries(labels))


def labels_json(labels: Column) -> Column:
    """Canonical JSON object text: keys in order, no spaces."""
    return F.to_json(F.map_from_entries(sorted_pairs(labels)))


def canonical(labels: str | Column = "labels") -> Column:
    """Canonical JSON of label text. Text that is no JSON object stays as it is, so that it remains a series of its own."""
    text = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(labels_json(labels_map(text)), F.nullif(F.trim(text), F.lit("")), F.lit("{}"))


def is_malformed(labels: str | Column = "labels") -> Column:
    """Whether label text is there but no JSON object; for counting such rows."""
    text = F.col(labels) if isinstance(labels, str) else labels
    return (F.coalesce(F.trim(text), F.lit("")) != "") & labels_map(text).isNull()


def series_key(df: DataFrame) -> Column:
    """Series identity: the name followed by the canonical labels."""
    if "series_key" in df.columns:
        return F.col("series_key")
    if dict(df.dtypes)["labels"].startswith("map"):
        return F.concat(F.col("name"), F.coalesce(labels_json(F.col("labels")), F.lit("{}")))
    return F.concat(F.col("name"), canonical())
