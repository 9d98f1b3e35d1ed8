"""Cleaning: empty, trim, length bounds, exact and prefix de-duplication, outcome counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.functions import messages as M
from tuneprep.functions.text import once, strip
from tuneprep.operators.formats import assemble_chats
from tuneprep.operators.ranking import first_rows, keep_first
from tuneprep.schema import MESSAGES

OUTCOMES = ["total", "kept", "removed", "empty", "too_short", "too_long", "duplicate"]


@dataclass(frozen=True)
class CleanOptions:
    remove_duplicates: bool = True
    remove_empty: bool = True
    min_length: int = 10
    max_length: int = 8192
    trim_whitespace: bool = True


def _outcome(no_messages: Column, blank: Column, length: Column, opts: CleanOptions) -> Column:
    empty = no_messages | blank if opts.remove_empty else no_messages
    return (
        F.when(empty, "empty")
        .when(length < opts.min_length, "too_short")
        .when(length > opts.max_length, "too_long")
        .otherwise("pass")
    )


def classify(records: DataFrame, opts: CleanOptions = CleanOptions()) -> DataFrame:
    """Add ``outcome`` (checks before de-duplication) and replace messages by trimmed ones."""
    messages = F.coalesce(F.col("messages"), F.array().cast(MESSAGES))
    if opts.trim_whitespace:
        messages = M.trim_messages(messages)
    kept = [c for c in records.columns if c != "messages"]

    def judge(m: Column) -> Column:
        blank = ~M.has_text(m, stripped=opts.trim_whitespace)
        outcome = _outcome(F.size(m) == 0, blank, M.text_length(m), opts)
        return F.struct(m.alias("messages"), outcome.alias("outcome"))

    return records.select(*kept, once(messages, judge).alias("_r")).select(*kept, "_r.*")


def clean(records: DataFrame, opts: CleanOptions = CleanOptions(),
          order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Surviving records; among equal ones the first in ``order`` stays."""
    passed = classify(records, opts).filter(F.col("outcome") == "pass").drop("outcome")
    if not opts.remove_duplicates:
        return passed
    return keep_first(passed, list(order), {"_fp": M.fingerprint(F.col("messages"))})


def _stats_from(groups: DataFrame, opts: CleanOptions) -> DataFrame:
    """Long-form counts from (outcome, fingerprint, n) groups."""

    def rows(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome") == kind, F.col("n"))),
                          F.lit(0).cast("long"))

    passed = F.col("outcome") == "pass"
    kept = F.count(F.when(passed, F.lit(1))) if opts.remove_duplicates else rows("pass")
    counts = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"),
        rows("empty").alias("empty"),
        rows("too_short").alias("too_short"),
        rows("too_long").alias("too_long"),
        rows("pass").alias("passed"),
        kept.cast("long").alias("kept"),
    ).select(
        "total", "kept", (F.col("total") - F.col("kept")).alias("removed"), "empty", "too_short",
        "too_long", (F.col("passed") - F.col("kept")).alias("duplicate"),
    )
    pairs = ", ".join(f"'{name}', {name}" for name in OUTCOMES)
    return counts.select(F.expr(f"stack({len(OUTCOMES)}, {pairs}) AS (outcome, n)"))


def clean_stats(records: DataFrame, opts: CleanOptions = CleanOptions()) -> DataFrame:
    """Rows per outcome. Copies collapse in the partial aggregate, so no key gets hot."""
    marked = classify(records, opts)
    fp = F.when(F.col("outcome") == "pass", M.fingerprint(F.col("messages")))
    groups = (
        marked.select("outcome", fp.alias("fp"))
        .groupBy("outcome", "fp")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _stats_from(groups, opts)


# --- Chats that still are one row per turn -------------------------------------------------


def _turn_digests(content: Column) -> list[Column]:
    """Four 60-bit slices of a hash that covers position, role and text of one turn."""
    digest = F.sha2(F.to_json(F.struct(F.col("_place"), F.col("role"), content.alias("text"))), 256)
    return [
        F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)")
        for i in range(4)
    ]


def placed_turns(turns: DataFrame) -> DataFrame:
    """Add ``_place``, the zero-based position of a turn in its chat.

    Where the turn numbers of a chat have no gaps, it is the difference to the first one; only
    chats with gaps are ranked.
    """
    bounds = turns.groupBy("ord").agg(
        F.min("turn").alias("_first"),
        (F.max("turn") - F.min("turn") + 1 == F.count("turn")).alias("_dense"))
    marked = turns.join(bounds, "ord")
    dense = marked.filter(F.col("_dense")).withColumn("_place", F.col("turn") - F.col("_first"))
    rank = F.row_number().over(Window.partitionBy("ord").orderBy("turn"))
    gaps = marked.filter(~F.coalesce("_dense", F.lit(False))).withColumn(
        "_place", (rank - 1).cast("long"))
    return dense.unionByName(gaps).drop("_first", "_dense")


def classify_turns(turns: DataFrame, opts: CleanOptions = CleanOptions()) -> DataFrame:
    """One row per chat with ``outcome`` and an order-aware fingerprint, from turn rows.

    Everything is a sum, maximum or count, so a chat of any size is combined map-side and no
    array is built. Positions count from the chat's first turn.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    content = strip(content) if opts.trim_whitespace else content
    slices = _turn_digests(F.col("_text"))
    return (
        placed_turns(turns).select("ord", "_place", "turn", "role", content.alias("_text"))
        .groupBy("ord")
        .agg(
            F.sum(F.length("_text").cast("long")).alias("length"),
            F.max(strip(F.col("_text")) != "").alias("has_text"),
            F.count(F.lit(1)).alias("n_turns"),
            *[F.sum(s).alias(f"d{i}") for i, s in enumerate(slices)],
        )
        .select(
            "ord", "length", "n_turns",
            F.struct("n_turns", "d0", "d1", "d2", "d3").alias("fp"),
            _outcome(F.lit(False), ~F.col("has_text"), F.col("length"), opts).alias("outcome"),
        )
    )


def clean_turns(turns: DataFrame, opts: CleanOptions = CleanOptions()) -> DataFrame:
    """Surviving chats of a turn table as (ord, messages); the per-chat checks come first."""
    passed = classify_turns(turns, opts).filter(F.col("outcome") == "pass")
    if opts.remove_duplicates:
        passed = passed.groupBy("fp").agg(F.min("ord").alias("ord"))
    content = F.coalesce(F.col("content"), F.lit(""))
    content = strip(content) if opts.trim_whitespace else content
    kept = turns.join(passed.select("ord"), "ord", "left_semi")
    return assemble_chats(kept.withColumn("content", content))


def clean_turn_stats(turns: DataFrame, opts: CleanOptions = CleanOptions()) -> DataFrame:
    """Rows per outcome for a turn table."""
    fp = F.when(F.col("outcome") == "pass", F.col("fp"))
    groups = (
        classify_turns(turns, opts)
        .select("outcome", fp.alias("fp"))
        .groupBy("outcome", "fp")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _stats_from(groups, opts)


# --- Simple filters ------------------------------------------------------------------------


def dedup_prefix(rows: DataFrame, text: str, n: int, *order: str) -> DataFrame:
    """First row (by ``order``, default ord) per leading ``n`` characters of a text column."""
    return keep_first(rows, list(order or ("ord",)), {"_prefix": F.substring(F.col(text), 1, n)})


def cap_first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Exactly the first ``n`` rows in ``order`` (default ord), nulls first.

    Ties of the order columns go by a hash of the whole row.
    """
    return first_rows(rows, list(order or ("ord",)), n)


def min_answer_length(rows: DataFrame, n: int, column: str = "output") -> DataFrame:
    """Rows whose answer is longer than ``n`` characters."""
    return rows.filter(F.length(column) > n)
