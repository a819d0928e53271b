"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.llm import centroids, chat, decontam, lines, packing, quality, rules, sparse, simhash, spelling, tokens, warc, webtext
from gaugeline.llm.common import table
from gaugeline.llm.sql import ARCHIVES, CENTROIDS, CHAT, DECONTAMINATION, LINES, SPELLING
from gaugeline.session import work_dir

#: Parameters of the contracts.
SHINGLE, RADIUS = 4, 4
WINDOW = 13
TOKEN_LIMIT = SEQUENCE = 1024
THRESHOLD = 0.3
REPEATED_WORDS = 50
DIMENSIONS, SCALE, CENTROID_COUNT, ROUNDS, SEED = 64, 64, 16, 3, "1:"
SHORTEST, OCCURRENCES, FORM_RATIO = 6, 5, 5
REVISITED_BYTES = 1000


def vocabulary_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, RADIUS)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=WINDOW)
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return result.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary_file(), TOKEN_LIMIT)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.repeated_passages(table(spark, sf_dir, "documents"), REPEATED_WORDS)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file(), SEQUENCE, with_ids=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"), "source", once=True)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), THRESHOLD)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit(r"\### Assistant: </turn> ok")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.examples(rows))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), dimensions=DIMENSIONS, scale=SCALE, k=CENTROID_COUNT, rounds=ROUNDS, seed=SEED)
    digest = F.sha2(F.array_join("centroid", ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), SHORTEST, OCCURRENCES, FORM_RATIO)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, REVISITED_BYTES)
    records = warc.read(spark, path, payloads=False).where("reason IS NULL")
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_near_dedup, op2_benchmark_decontamination, op3_token_counts, op4_suffix_array_dedup, op5_html_extraction,
        op6_packing, op7_quality_rules, op8_line_dedup, op9_quality_classifier, op10_chat_formatting,
        op11_centroid_clustering, op12_spelling_variants, op13_warc,
    )
}
ORACLES = {
    "op2_benchmark_decontamination": DECONTAMINATION, "op8_line_dedup": LINES, "op10_chat_formatting": CHAT,
    "op11_centroid_clustering": CENTROIDS, "op12_spelling_variants": SPELLING, "op13_warc": ARCHIVES,
}
