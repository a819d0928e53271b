"""From landed scrape bodies to stored samples and scrape outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import PROMOTED, labels_json
from ..session import checkpointed, small_side
from ..sources.payloads import MAX_BODY_BYTES, classify_payloads
from .exposition import (
    decompose_histograms, decompose_summaries, inject_target, line_counts, line_kinds, metric_type, parsed_samples, value_of, with_labels,
)

# Samples kept per scrape, names reserved for the collector itself, and the
# metric prefixes accepted from a target that lists none.
MAX_SAMPLES = 5_000
DENY_PREFIXES = ("collector_",)
DEFAULT_ALLOW = ("http_", "visitors_", "unique_")


@dataclass(frozen=True)
class IngestConfig:
    """Limits and names.

    ``own_namespaces`` are prefixes of the metrics an instrumented app's own engine exports, such
    as ``engine`` for ``engine_*``: they are accepted by default, except ``<namespace>_dropped_total``,
    which means nothing once added up over several apps. ``drop_counter_namespaces`` names the
    namespaces whose drop counter is denied, if those are not all of them. ``count_lines`` gives every outcome a struct
    ``text`` of its body's lines by what they are; all lines are then looked at, not only those of accepted families.
    """

    max_samples: int = MAX_SAMPLES
    max_body_bytes: int = MAX_BODY_BYTES
    deny_prefixes: tuple[str, ...] = DENY_PREFIXES
    own_namespaces: tuple[str, ...] = ()
    drop_counter_namespaces: tuple[str, ...] = ()
    count_lines: bool = False

    @property
    def deny_exact(self) -> tuple[str, ...]:
        return tuple(f"{n}_dropped_total" for n in self.drop_counter_namespaces or self.own_namespaces)

    @property
    def default_allow(self) -> tuple[str, ...]:
        return DEFAULT_ALLOW + tuple(f"{n}_" for n in self.own_namespaces)


def denied(family: Column, config: IngestConfig = IngestConfig()) -> Column:
    out = F.lit(False)
    if config.deny_exact:
        out = family.isin(*config.deny_exact)
    for prefix in config.deny_prefixes:
        out = out | family.startswith(prefix)
    return out


def default_allow(allow: Column, config: IngestConfig = IngestConfig()) -> Column:
    """An empty list of prefixes means the default ones."""
    given = F.filter(F.coalesce(allow, F.array().cast("array<string>")), lambda p: p != "")
    return F.when(F.size(given) > 0, given).otherwise(F.array(*[F.lit(p) for p in config.default_allow]))


def allowlist_semi_join(samples: DataFrame, targets: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Samples whose family starts with a prefix of their own target (table form of the allowlist)."""
    prefixes = targets.select(
        F.col("name").alias("target"), F.explode(default_allow(F.col("allow"), config)).alias("prefix")
    ).distinct()
    return samples.join(
        small_side(prefixes).alias("p"),
        (samples["target"] == F.col("p.target")) & samples["family"].startswith(F.col("p.prefix")),
        "left_semi",
    )


def cap_rank(samples: DataFrame) -> DataFrame:
    """Rank of a sample within its scrape by line; the body limit bounds a scrape."""
    return samples.withColumn("rank", F.row_number().over(Window.partitionBy("scrape_id").orderBy("line_no")))


def cap_samples(samples: DataFrame, cap: int = MAX_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """First ``cap`` samples of each scrape, and how many each scrape kept and lost."""
    kept = cap_rank(samples).filter(F.col("rank") <= cap).drop("rank")
    sizes = samples.groupBy("scrape_id").agg(F.count(F.lit(1)).alias("n")).select(
        "scrape_id", F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("dropped")
    )
    return kept, sizes


def staged(payloads: DataFrame, targets: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Payload rows with status and the array of their accepted sample lines; no shuffle.

    The target table joins the payload rows, of which there are far fewer than samples. A name that is
    registered twice is one target with the prefixes of both. An attempt at a target that is not
    registered stays, as ``fetch_error`` for the reason ``unknown_target``.
    """
    rows = targets.select(F.col("name").alias("target"), default_allow(F.col("allow"), config).alias("allow"))
    allow = rows.groupBy("target").agg(F.array_distinct(F.flatten(F.collect_list("allow"))).alias("allow"))
    rows = classify_payloads(payloads, config.max_body_bytes).join(small_side(allow), "target", "left")
    rows = rows.withColumn("fetch_reason", F.coalesce("fetch_reason", F.when(F.col("allow").isNull(), "unknown_target")))
    rows = rows.withColumn("status", F.when(F.col("fetch_reason").isNull(), "ok").otherwise("fetch_error"))
    # An accepted family starts with a prefix, so its lines do too: the others are not looked at.
    found = parsed_samples(
        F.when(F.col("status") == "ok", F.col("body").cast("string")),
        lambda line: F.exists("allow", lambda p: line.startswith(p)),
    )
    accepted = F.filter(
        found,
        lambda s: ~denied(s["family"], config) & F.exists("allow", lambda p: s["family"].startswith(p)),
    )
    if config.count_lines:
        rows = rows.withColumn("text", line_counts(line_kinds(F.when(F.col("status") == "ok", F.col("body").cast("string")))))
    return rows.withColumn("accepted", accepted).drop("body", "allow")


def samples_from(stage: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Stored samples in the history schema, with identity and frequent labels as columns.

    ``seq`` orders samples by arrival: by scrape, then by line.
    """
    rows = stage.filter(F.col("status") == "ok").select(
        "scrape_id", "target", F.col("scrape_ts").alias("ts"), "seq",
        F.inline_outer(F.slice("accepted", 1, config.max_samples)),
    )
    named = with_labels(rows.filter(F.col("line_no").isNotNull())).withColumn("value", value_of(F.col("line")))
    typed = decompose_summaries(decompose_histograms(named))
    labelled = typed.withColumn("labels", inject_target(F.col("labels"), F.col("target")))
    return labelled.select(
        "scrape_id", "target", "ts", "name", metric_type().alias("metric_type"), "value",
        labels_json(F.col("labels")).alias("labels"), "line_no", "seq",
        *[F.col("labels")[key].alias(key) for key in PROMOTED],
    )


def outcomes_from(stage: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """One row per attempt. Text always parses (bad lines are skipped, and counted if asked for), so there is no parse error here."""
    n = F.when(F.col("status") == "ok", F.size("accepted")).otherwise(0)
    return stage.select(
        "scrape_id", "target", F.col("scrape_ts").alias("ts"), "seq", "status", "fetch_reason",
        F.least(n, F.lit(config.max_samples)).cast("bigint").alias("samples"),
        F.greatest(n - config.max_samples, F.lit(0)).cast("bigint").alias("dropped"),
        *[c for c in ("duration_ms", "text") if c in stage.columns],
    )


def ingest(
    payloads: DataFrame, targets: DataFrame, config: IngestConfig = IngestConfig()
) -> tuple[DataFrame, DataFrame]:
    """Samples and outcomes of a payload table. The bodies are parsed once; what they gave is kept in the shared folder."""
    stage = checkpointed(staged(payloads, targets, config))
    return samples_from(stage, config), outcomes_from(stage, config)


def self_metrics(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The collector's own counters in the history schema, stamped ``as_of``."""
    totals = outcomes.groupBy("target", "status").agg(
        F.count(F.lit(1)).cast("double").alias("scrapes"), F.sum("samples").cast("double").alias("stored"), F.sum("dropped").cast("double").alias("dropped"),
    )
    ok, of = F.col("status") == "ok", (F.lit("target"), F.col("target"))

    def counter(kind: str, value: str, *labels: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(f"collector_{kind}_total").alias("name"), F.col(value).alias("value"), F.create_map(*of, *labels).alias("l"))
        return made if when is None else F.when(when, made)

    counters = F.array(
        counter("scrape", "scrapes", F.lit("status"), F.col("status")), counter("samples_stored", "stored", when=ok),
        counter("samples_dropped", "dropped", F.lit("reason"), F.lit("over_cap"), when=ok & (F.col("dropped") > 0)),
    )
    rows = totals.select(F.inline(F.array_compact(counters)))
    return rows.select(
        as_of.alias("ts"), "name", "value", F.lit("counter").alias("metric_type"), labels_json(F.col("l")).alias("labels")
    )
