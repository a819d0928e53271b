"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes what the stage before kept; all but the last return the columns of documents. Every stage's rows are
written to the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.llm import decontam, lines, packing, quality, simhash
from gaugeline.llm.common import stored, table
from gaugeline.llm.queries import RADIUS, SEQUENCE, SHINGLE, THRESHOLD, WINDOW, vocabulary_file

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars says what is left.

    Copies and near copies are one page of their source here, grouped as the next stage groups them, which keeps one of
    them: so a line that only they share is no boilerplate. What is grouped is hashes of lines; no text is shuffled for it.
    """
    pages = simhash.with_fingerprints(docs.select("source", "text"), SHINGLE)
    pages = stored(pages.select("source", lines.bare(F.col("text")).alias("hashes"), "fingerprint"), "pipeline-lines")
    groups = simhash.rooted_prints(pages.select("fingerprint").distinct(), RADIUS)
    listed = lines.boilerplate_of_groups(pages.join(groups, "fingerprint"), "source", "hashes", "root")
    kept = lines.drop_boilerplate(docs, "source", listed=listed)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs, SHINGLE, RADIUS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), window=WINDOW)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in sequences along the curve."""
    return packing.pack(docs, vocabulary_file(), SEQUENCE)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
