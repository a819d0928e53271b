"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its reply as the one trainable
span. Turns after the last reply are given by one more example that trains nothing, so no turn is lost. The template is

    <turn role="ROLE">TEXT</turn>

and a line feed. Inside texts and roles, backslash, < and > are written \\b, \\l and \\g, so no text can contain a mark, and
undoing this in reverse order gives the text back.

Defined cases: turns are ordered by turn, then role, then text, nulls first; null texts and null roles are empty; rows
of a null conv_id are one conversation; repeated rows are turns each; a conversation without replies has the one example
that trains nothing; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CODES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
CLOSE = "</turn>\n"


def escaped(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def opening(role: Column) -> Column:
    return F.concat(F.lit('<turn role="'), escaped(role), F.lit('">'))


def examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), n_turns in it, complete (it has all turns), formatted, and the trainable span.

    The span (mask_start, mask_end) counts characters; null trains nothing. One conversation is one row on the way, as it is in its last example.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = grouped.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(opening(t["role"]), escaped(t["text"]), F.lit(CLOSE))).alias("parts"))
    # one example for each reply, and one for what follows the last reply
    last = F.size("turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == target) | (i == last))
    exploded = written.select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "at"))
    reply = F.get("turns", F.col("at"))
    whole = exploded.select(
        "conv_id", "example", (F.col("at") + 1).cast("long").alias("n_turns"), (F.col("at") == last).alias("complete"),
        F.concat_ws("", F.slice("parts", F.lit(1), F.col("at") + 1)).alias("formatted"),
        F.when(reply["role"] == target, F.length(escaped(reply["text"]))).alias("span"),
    )
    end = F.length("formatted") - len(CLOSE)
    return whole.select(
        "conv_id", "example", "n_turns", "complete", "formatted",
        F.when(F.col("span").isNotNull(), end - F.col("span")).cast("long").alias("mask_start"),
        F.when(F.col("span").isNotNull(), end).cast("long").alias("mask_end"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted example says."""
    marks = F.regexp_extract_all(formatted, F.lit(r'<turn role="[^<>]*">[^<>]*</turn>'), F.lit(0))
    return F.transform(marks, lambda m: F.struct(
        unescaped(F.regexp_extract(m, r'^<turn role="([^<>]*)">', 1)).alias("role"),
        unescaped(F.regexp_extract(m, r">([^<>]*)<", 1)).alias("text"),
    ))


def trained(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was before escaping; null if nothing is trained."""
    return unescaped(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: what its turns and the text under the masks come to.

    Each example is cut down to its masked text at once; only the example of all turns is parsed.
    """
    spoken = F.concat_ws("", F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    turns = formatted.select(
        "conv_id", "example", "n_turns", F.length("formatted").cast("long").alias("chars"),
        trained(F.col("formatted"), F.col("mask_start"), F.col("mask_end")).alias("loss"),
        F.when(F.col("complete"), F.sha2(spoken, 256)).alias("turns_sha256"),
    )
    back = turns.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: F.coalesce(x["loss"], F.lit("")))).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
