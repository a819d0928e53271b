"""What the operators share: table access, intermediates in the shared folder, ASCII folding."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeline.session import stored  # noqa: F401

#: White space as the contracts name it: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw(text: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def folded(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_key(*columns: str) -> Column:
    """64 bits that stand for a row; repeated rows share them."""
    return F.xxhash64(*columns)


def quoted(name: str) -> Column:
    """A column by its name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")
