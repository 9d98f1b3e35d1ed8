"""Quality rules: counts within a document, and the frequency of its lines across documents.

Method: hash normalised lines, count the distinct documents of each host that have a line, remove
lines above the limit, and reject documents that are depleted by it.

Everything up to the line hashes is one projection over the text; the rest works on small rows
(hash, host, document), which are pre-aggregated before each shuffle, so a line that a third of
all documents share is one row per task.

Defined results: a null text has no words; null hosts form one host; repeated rows are judged
each on their own and count once for a line, as do exact copies under other ids; an empty table
gives an empty table; other columns of the input are ignored (``apply_rules`` passes them on).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import (SPACE_CLASS, SPACES, frozen, let, plain_columns, space_words,
                                 with_default)


@dataclass(frozen=True)
class QualityOptions:
    """Limits of the rules.

    A line is removed where more than ``max(min_line_docs, line_share * documents)`` distinct
    documents of a host have it; the host's document with the smallest id keeps it, so the text
    of a group of near copies is not lost. A document is depleted when fewer than ``min_words``
    words or less than ``min_left_share`` of its words are left.
    """

    min_words: int = 20
    max_repeat_share: float = 0.30
    window: int = 8
    min_line_docs: int = 50
    line_share: float = 0.005
    min_left_share: float = 0.30


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACES)), SPACE_CLASS, " ")


def repeated_words(words: Column, size: int) -> Column:
    """Number of words inside windows of ``size`` words that occur twice or more in the array."""
    def covered(hashes: Column) -> Column:
        spots = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        shared = let(spots, lambda s: F.filter(s, lambda e, i: (
            (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))))
        starts = F.sort_array(F.transform(shared, lambda e: e["i"]))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(
                F.coalesce(F.get(p, i + 1) - x, F.lit(size)), F.lit(size))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    # Elements are read one by one, because each slice() call would copy the whole array. Windows
    # that run over the end are cut off at the end; missing neighbours compare as null, i.e. false.
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)])),
        F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0))))
    return let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def measure(docs: DataFrame, options: QualityOptions, doc_id: str, text: str,
            host: str) -> DataFrame:
    """One row per input row: counts, and its lines as (hash, words, times)."""
    base = plain_columns(docs, {"doc_id": doc_id, "text": text, "host": host})
    value = with_default(F.col("text"))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = base.select(
        "doc_id", "host", F.xxhash64(value).alias("text_hash"),
        F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .alias("n_dup_lines"),
        F.transform(lines, lambda x: F.struct(
            F.xxhash64(normal_line(x)).alias("line"),
            F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
        ).alias("lines"),
        let(space_words(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w, options.window).alias("n_repeat_words"))).alias("w"),
    )
    failed = ((F.col("n_words") < options.min_words)
              | (100 * F.col("n_repeat_words")
                 > round(100 * options.max_repeat_share) * F.col("n_words")))
    return (rows.select("doc_id", "host", "text_hash", "w.*", "n_symbols", "n_dup_lines", "lines")
            .withColumn("base_failed", failed)
            .withColumn("row_id", F.monotonically_increasing_id()))


def frequent_lines(measured: DataFrame, options: QualityOptions) -> DataFrame:
    """(host, line, first_doc) of the lines above their host's limit."""
    hosts = measured.groupBy("host").agg(F.count_distinct("text_hash").alias("host_docs"))
    occurrences = measured.select(
        "host", "doc_id", "text_hash",
        F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = (occurrences.groupBy("host", "line")
              .agg(F.count_distinct("text_hash").alias("docs"), F.min("doc_id").alias("first_doc"))
              .where(F.col("docs") > options.min_line_docs))
    return (counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
            .where(F.col("docs") > options.line_share * F.col("host_docs"))
            .select("c.host", "c.line", "c.first_doc"))


def judged(docs: DataFrame, options: QualityOptions = QualityOptions(), doc_id: str = "doc_id",
           text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: counts, removed lines (hashes) and words, ``base_failed``, ``kept``."""
    measured = frozen(measure(docs, options, doc_id, text, host), "quality")
    frequent = frozen(frequent_lines(measured, options), "frequent-lines")
    lines = (measured.select("row_id", "host", "doc_id", F.explode("lines").alias("x"))
             .select("row_id", "host", "doc_id", "x.line", "x.words"))
    removed = (lines.alias("l").join(frequent.alias("f"), (F.col("l.line") == F.col("f.line"))
                                     & F.col("l.host").eqNullSafe(F.col("f.host")))
               .where(~F.col("l.doc_id").eqNullSafe(F.col("f.first_doc")))
               .groupBy("row_id").agg(F.sum("words").alias("removed_words"),
                                      F.collect_set("l.line").alias("removed_lines")))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < options.min_words) | (left < options.min_left_share * F.col("n_words"))
    return (measured.drop("lines").join(removed, "row_id", "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
            .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
            .withColumn("kept", ~F.col("base_failed") & ~depleted))


def apply_rules(docs: DataFrame, options: QualityOptions = QualityOptions(),
                doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The kept rows with all their columns; ``text`` has lost its removed lines.

    Only kept rows are shuffled with their texts, once, on (id, text hash).
    """
    verdict = (judged(docs, options, doc_id, text, host).where("kept")
               .select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"),
                       F.col("text_hash").alias("_hash"), F.col("removed_lines").alias("_lines"))
               .dropDuplicates(["_id", "_host", "_hash"]))
    value = with_default(F.col(f"`{text}`"))
    kept_lines = F.array_join(F.filter(F.split(value, "\n"), lambda x: ~F.array_contains(
        F.col("_lines"), F.xxhash64(normal_line(x))) | (F.btrim(x, F.lit(SPACES)) == "")), "\n")
    cleaned = F.when(F.size("_lines") == 0, F.col(f"`{text}`")).otherwise(kept_lines)
    keyed = docs.withColumn("_text_key", F.xxhash64(value))
    return (keyed.join(verdict.hint("merge"), (F.col("_text_key") == F.col("_hash"))
                       & F.col(f"`{doc_id}`").eqNullSafe(F.col("_id"))
                       & F.col(f"`{host}`").eqNullSafe(F.col("_host")))
            .withColumn(text, cleaned).select(*[f"`{c}`" for c in docs.columns]))
