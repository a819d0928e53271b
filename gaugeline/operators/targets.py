"""The target dimension: declared and added targets, their overrides, and checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed, small_side
from .components import components
from .ingest import IngestConfig, default_allow

# Fixed value: targets that may be added at run time.
MAX_DYNAMIC = 64
# Clashing rows that one task settles: three short columns of each.
AT_ONCE = 500_000
# The least rows that a block of a larger group takes.
LEAST_AT_ONCE = 16
_URL = r"^https?://\S*$"


def union_targets(config: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Declared targets first, then added ones; ``ord`` keeps that order."""
    first = config.withColumn("ord", F.lit(0)).withColumn("origin", F.lit("config"))
    return first.unionByName(dynamic.withColumn("ord", F.lit(1)).withColumn("origin", F.lit("dynamic")))


def fold_overrides(log: DataFrame) -> DataFrame:
    """Current override per target from a log of ``(id, seq, op)``, op enable, disable or remove.

    Enabling or disabling brings a removed target back; removing leaves the enabled flag alone.
    """
    switch = F.col("op").isin("enable", "disable")
    return log.groupBy("id").agg(
        F.max_by(F.col("op") == "enable", F.when(switch, F.col("seq"))).alias("enabled"),
        (F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("seq"))), F.lit(-1))
         > F.coalesce(F.max(F.when(switch, F.col("seq"))), F.lit(-1))).alias("removed"),
    )


def apply_overrides(targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Enabled flag of declared targets as overridden."""
    ov = overrides.select("id", F.col("enabled").alias("_enabled"))
    flagged = targets.join(small_side(ov), "id", "left")
    own = F.when(F.col("origin") == "config", F.col("_enabled"))
    return flagged.withColumn("enabled", F.coalesce(own, "enabled")).drop("_enabled")


def drop_removed(targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Targets without a tombstone."""
    return targets.join(small_side(overrides.filter("removed").select("id")), "id", "left_anti")


_ORDER = ("ord", "id", "_name", "_url", "_row")


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_row`` of the accepted ones among rows in order; groups share no name or address, and one is held at a time."""
    group, names, urls = None, set(), set()
    for batch in batches:
        won = []
        for of, row, name, url in zip(batch["_group"], batch["_row"], batch["_name"], batch["_url"], strict=True):
            if of != group:
                group, names, urls = of, set(), set()
            name, url = (None if pd.isna(x) else x for x in (name, url))
            if name not in names and url not in urls:
                names.add(name)
                urls.add(url)
                won.append(row)
        if won:
            yield pd.DataFrame({"_row": won})


def _settled(clashing: DataFrame) -> DataFrame:
    """``_row`` of the accepted ones among rows that clash, taken in order by one task; the caller bounds them."""
    ordered = clashing.select(F.lit(0).cast("long").alias("_group"), *_ORDER).coalesce(1).sortWithinPartitions(*_ORDER)
    return ordered.select("_group", "_row", "_name", "_url").mapInPandas(_settle, "_row long")


def _settled_in_blocks(clashing: DataFrame, n: int, at_once: int) -> DataFrame:
    """The same for more rows than a task should take: blocks of the order one after another, each without what clashes
    with the accepted ones of those before."""
    parts = -(-n // max(at_once, LEAST_AT_ONCE))
    ordered = clashing.select(*_ORDER).repartitionByRange(parts, *_ORDER).withColumn("_block", F.spark_partition_id())
    ordered, accepted = checkpointed(ordered), None
    for (block,) in ordered.select("_block").distinct().sort("_block").collect():
        rows = ordered.filter(F.col("_block") == block)
        if accepted is not None:
            for key in ("_name", "_url"):
                taken = accepted.select(F.col(key).alias("_taken"))
                rows = rows.join(taken, F.col(key).eqNullSafe(F.col("_taken")), "left_anti")
            rows = checkpointed(rows)
        won = checkpointed(rows.join(_settled(rows), "_row", "left_semi").select("_row", "_name", "_url"))
        accepted = won if accepted is None else accepted.unionByName(won)
    return accepted.select("_row")


def _settled_by_group(clashing: DataFrame, at_once: int) -> DataFrame:
    """The same, group by group: a row links its name to its address, and rows clash only within a connected group. Tasks
    settle groups of up to ``at_once`` rows side by side; larger ones are settled in blocks."""
    keys = {f"{k}_key": F.xxhash64(F.lit(k), F.col(k).isNull(), F.col(k)) for k in ("_name", "_url")}
    keyed = clashing.select(*_ORDER).withColumns(keys)
    roots = components(keyed.select(F.col("_name_key").alias("u"), F.col("_url_key").alias("v"))).withColumnRenamed("u", "_name_key")
    grouped = checkpointed(
        keyed.join(roots, "_name_key", "left").select(*_ORDER, F.coalesce("root", "_name_key").alias("_group")))
    large = checkpointed(grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > at_once))
    rest = grouped.join(large, "_group", "left_anti").repartition("_group").sortWithinPartitions("_group", *_ORDER)
    won = rest.select("_group", "_row", "_name", "_url").mapInPandas(_settle, "_row long")
    n = large.agg(F.sum("_n")).first()[0]
    return won.unionByName(_settled_in_blocks(grouped.join(large, "_group", "left_semi"), n, at_once)) if n else won


def resolve_conflicts(targets: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Declared targets, and the added ones whose name and address no accepted target before them has.

    Declared ones come first, then ids in order. A refused target takes no name, so it refuses no other. An added row that
    shares neither name nor address with any other needs no look at the order; the rest, counted first, are settled in one
    pass in order, however long their chains, or group by group if they are more than ``at_once``.
    """
    keyed = targets.withColumns({"_name": F.trim("name"), "_url": F.trim("url"), "_row": F.monotonically_increasing_id()})
    held = checkpointed(keyed)
    added = held.filter("origin <> 'config'")
    for key in ("_name", "_url"):
        of = held.groupBy(F.col(key).alias(f"{key}_of")).agg(
            F.bool_or(F.col("origin") == "config").alias(f"{key}_declared"), F.count(F.lit(1)).alias(f"{key}_n"))
        added = added.join(of, F.col(key).eqNullSafe(F.col(f"{key}_of"))).filter(~F.col(f"{key}_declared"))
    alone = (F.col("_name_n") == 1) & (F.col("_url_n") == 1)
    free = checkpointed(added.select(*held.columns, alone.alias("_alone")))
    clashing = free.filter(~F.col("_alone")).drop("_alone")
    n = clashing.count()
    accepted = held.filter("origin = 'config'").unionByName(free.filter("_alone").drop("_alone"))
    if n:
        won = _settled(clashing) if n <= at_once else _settled_by_group(clashing, at_once)
        accepted = accepted.unionByName(clashing.join(won, "_row", "left_semi").select(*held.columns))
    return accepted.select(*targets.columns)


def effective_targets(config: DataFrame, dynamic: DataFrame, log: DataFrame) -> DataFrame:
    """The registry as readers see it: removed targets take no name, conflicting additions are refused."""
    overrides = fold_overrides(log)
    return resolve_conflicts(drop_removed(apply_overrides(union_targets(config, dynamic), overrides), overrides))


def recurring_enabled(targets: DataFrame) -> DataFrame:
    return targets.filter(F.col("enabled") & (F.col("mode") == "recurring"))


def with_default_allow(targets: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    return targets.withColumn("allow", default_allow(F.col("allow"), config))


def quality_checks(targets: DataFrame, max_dynamic: int = MAX_DYNAMIC) -> DataFrame:
    """One row per violation: ``reason, subject, n``."""

    def repeated(key: str, reason: str) -> DataFrame:
        groups = targets.groupBy(F.trim(key).alias("subject")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("origin") == "config").alias("declared"),
            F.count_if(F.col("origin") == "dynamic").alias("added"),
        ).filter("n > 1")
        conflict = (F.col("declared") > 0) & (F.col("added") > 0)
        return groups.select(
            F.when(conflict, F.lit(f"{reason}_conflicts_with_config")).otherwise(F.lit(f"duplicate_{reason}")).alias("reason"),
            "subject", "n",
        )

    def each(bad, reason: str, subject: str) -> DataFrame:
        return targets.filter(bad).groupBy(F.col(subject).alias("subject")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(reason).alias("reason"), "subject", "n"
        )

    over = targets.filter(F.col("origin") == "dynamic").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_dynamic)
    checks = [
        repeated("name", "name"), repeated("url", "url"),
        each(F.trim("name") == "", "blank_name", "id"), each(~F.trim("url").rlike(_URL), "bad_url", "url"),
        over.select(F.lit("too_many_dynamic").alias("reason"), F.lit("dynamic").alias("subject"), "n"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out
