"""Quality profile: lengths by role and record, histogram, language hint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.functions import messages as M
from tuneprep.functions.text import cjk_chars
from tuneprep.operators.ranking import first_rows
from tuneprep.rules.terms import LENGTH_BUCKETS

HINT_MESSAGES = 1000


def record_measures(records: DataFrame) -> DataFrame:
    """Lengths of each record, computed inside the row."""
    m = F.col("messages")
    return records.select(
        "ord",
        M.text_length(m).alias("length"),
        M.text_length(m, "user").alias("user_length"),
        M.role_count(m, "user").alias("user_n"),
        M.text_length(m, "assistant").alias("assistant_length"),
        M.role_count(m, "assistant").alias("assistant_n"),
    )


def turn_measures(turns: DataFrame) -> DataFrame:
    """The same from one row per turn, without building arrays."""
    size = F.length(F.coalesce(F.col("content"), F.lit(""))).cast("long")

    def total(role: str):
        return F.sum(F.when(F.col("role") == role, size).otherwise(F.lit(0).cast("long")))

    def count(role: str):
        return F.count(F.when(F.col("role") == role, F.lit(1)))

    return turns.groupBy("ord").agg(
        F.sum(size).alias("length"),
        total("user").alias("user_length"),
        count("user").alias("user_n"),
        total("assistant").alias("assistant_length"),
        count("assistant").alias("assistant_n"),
    )


def role_length_stats(measures: DataFrame) -> DataFrame:
    """Row count and average message length per role (0 when a role has no message)."""

    def average(role: str):
        n = F.sum(f"{role}_n")
        return F.coalesce(F.sum(f"{role}_length") / F.greatest(n, F.lit(1).cast("long")), F.lit(0.0))

    return measures.agg(
        F.count(F.lit(1)).alias("total_count"),
        average("user").alias("avg_user_length"),
        average("assistant").alias("avg_assistant_length"),
    )


def record_length_stats(measures: DataFrame) -> DataFrame:
    """Smallest, largest, average and total record length."""
    zero = F.lit(0).cast("long")
    return measures.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.coalesce(F.min("length"), zero).alias("min_total_length"),
        F.coalesce(F.max("length"), zero).alias("max_total_length"),
        F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_total_length"),
        F.coalesce(F.sum("length"), zero).alias("total_characters"),
    )


def length_histogram(measures: DataFrame) -> DataFrame:
    """Records per length range; ranges without records are present with zero."""
    size = F.col("length")
    counts = []
    for i, (_, low, high) in enumerate(LENGTH_BUCKETS):
        inside = size >= low if high is None else (size >= low) & (size < high)
        counts.append(F.count(F.when(inside, F.lit(1))).alias(f"b{i}"))
    pairs = ", ".join(f"'{name}', b{i}" for i, (name, _, _) in enumerate(LENGTH_BUCKETS))
    return measures.agg(*counts).select(
        F.expr(f"stack({len(LENGTH_BUCKETS)}, {pairs}) AS (bucket, n)")
    )


def language_hint(turns: DataFrame, max_messages: int | None = HINT_MESSAGES) -> DataFrame:
    """zh / mixed / en by the share of CJK characters.

    ``max_messages`` takes the first messages in (ord, turn) order, as the hint is defined;
    ``None`` reads all of them.
    """
    text = turns.select("ord", "turn", F.coalesce(F.col("content"), F.lit("")).alias("content"))
    if max_messages is not None:
        text = first_rows(text, ["ord", "turn"], max_messages)
    return (
        text.agg(
            F.coalesce(F.sum(cjk_chars(F.col("content"))), F.lit(0).cast("long")).alias("cjk"),
            F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0).cast("long"))
            .alias("characters"),
        )
        .withColumn("share", F.col("cjk") / F.greatest(F.col("characters"), F.lit(1).cast("long")))
        .select(
            "cjk", "characters",
            F.when(F.col("share") > 0.3, "zh").when(F.col("share") > 0.05, "mixed")
            .otherwise("en").alias("language_hint"),
        )
    )


def record_turns(records: DataFrame) -> DataFrame:
    """Message rows (ord, turn, role, content) of nested records."""
    return records.select("ord", F.posexplode("messages").alias("turn", "m")).select(
        "ord", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )
