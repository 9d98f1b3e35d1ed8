"""Importance resampling towards a target distribution.

Features are all runs of one to three words, hashed into buckets (CRC-32 modulo ``buckets``). The
buckets' counts over all documents and over the target texts give one gain per bucket, the scaled
log ratio of the smoothed shares. A document's weight is the sum of its features' gains, taken
from that array; a Gumbel-like value from its id's hash makes the best ``percent`` of the scores
a weighted draw without replacement.

The counts are one array per task, summed by bucket. The draw is a distributed quickselect on
the composite key (score descending, id ascending, null ids last, row number): random pivot keys
are drawn from the rows still in question, one aggregate counts exactly the rows before and at
each, and the range between two neighbouring pivots is kept until a pivot is the k-th key. Only
the drawn rows are sorted, by ranges, and ranked; nothing else moves. The driver holds
``buckets`` counts and ``PIVOTS`` keys.

Defined results: null texts have no words and weight 0; fewer words than a run's length give no
such runs; ties in score go to the smaller id, equal ids to the earlier row of the table as read;
a null id hashes as the empty text; repeated rows are drawn each by themselves; texts of any
length are whole (read in blocks of ``BLOCK`` bytes); an empty table gives an empty table, an
empty target has no features (t = T = 0); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, plain_columns
from tuneprep.operators.ranking import exact_rank

BUCKETS = 10_000
RUNS = 3                # words of the longest feature
MIN_WORDS = 20
PERCENT = 5
SEED = 42
BLOCK = 1 << 22         # bytes of a text whose features are held at once
PIVOTS = 31             # keys that cut the remaining range in each round

#: Bytes to word characters: ASCII digits and letters (lower-cased) and all above; others split.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32
                   for c in range(256))


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text in order, in blocks that end between words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def feature_blocks(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, bucket of each feature that ends in the block).

    A run's checksum continues that of the run without its last word, so no run is built.
    """
    before: list[bytes] = []
    for words in word_blocks(text):
        row = before + words
        spaced = [b" " + w for w in row[1:]]
        sums = list(map(crc32, row))
        found = sums[len(before):]
        for length in range(1, RUNS):
            sums = list(map(crc32, spaced[length - 1:], sums))
            found += sums[max(0, len(before) - length):]
        before = row[-(RUNS - 1):]
        yield len(words), np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket over all rows of a ``text`` column; at most ``buckets`` rows a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for _, found in feature_blocks(text.as_py(), buckets):
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select("text").where("text IS NOT NULL").mapInArrow(run, "bucket bigint, n bigint")
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the smoothed shares of each bucket, rounded down."""
    size, everything, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * float(everything + size) / ((s + 1) * float(wanted + size))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Scaled Gumbel value of an id, rounded down."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of (doc_id, text) rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((4, len(batch)), np.int64)
            for i, (key, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"))):
                for n_words, found in feature_blocks(text.as_py(), len(gain)):
                    rows[:3, i] += (n_words, len(found), gain[found].sum())
                rows[3, i] = rows[2, i] + noise(key.as_py(), seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(r) for r in rows]], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _key() -> Column:
    """Composite key of a scored row; ascending order is the order of the draw."""
    return F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("z"),
                    F.col("doc_id").alias("d"), F.col("row").alias("r"))


def _literal(key: Row, kind: str) -> Column:
    return F.struct(F.lit(key["s"]).cast("bigint").alias("s"), F.lit(key["z"]).alias("z"),
                    F.lit(key["d"]).cast(kind).alias("d"), F.lit(key["r"]).cast("bigint").alias("r"))


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> Column:
    """The k-th smallest key (from 1) of the table, as a literal.

    Every round draws random pivots among the rows still in question and counts, exactly and in
    one aggregate, the rows before and at each of them. Where no more rows than pivots are left,
    all are pivots, so the search ends.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    keys, skipped, turn = rows.select(_key().alias("k")), 0, 0
    low = high = None
    while True:
        left = keys
        if low is not None:
            left = left.where(F.col("k") > _literal(low, kind))
        if high is not None:
            left = left.where(F.col("k") < _literal(high, kind))
        drawn = sorted(row["k"] for row in left.orderBy(
            F.xxhash64("k.r", F.lit(turn)), "k.r").limit(pivots).collect())
        points = [_literal(p, kind) for p in drawn]
        less = left.agg(*[F.count_if(F.col("k") < p) for p in points],
                        *[F.count_if(F.col("k") == p) for p in points]).first()
        passed, turn = skipped, turn + 1
        for i, pivot in enumerate(drawn):
            before, upto = skipped + less[i], skipped + less[i] + less[len(drawn) + i]
            if before < k <= upto:
                return points[i]
            if k <= before:
                high = pivot
                break
            low, passed = pivot, upto
        skipped = passed


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, seed: int = SEED, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_features``, ``weight``, ``score``, ``rank``.

    ``rank`` counts the drawn documents from 1: the best ``percent`` of those with at least
    ``min_words`` words. It is null for all others.
    """
    rows = plain_columns(docs, {"doc_id": doc_id, "text": text})
    gain = gains(bucket_counts(rows, buckets),
                 bucket_counts(plain_columns(target, {"text": text}), buckets))
    table = frozen(scored(rows, gain, seed).withColumn("row", F.monotonically_increasing_id()),
                   "scored")
    eligible = F.col("n_words") >= min_words
    k = percent * table.where(eligible).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return table.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    drawn = eligible & (_key() <= kth_key(table.where(eligible), k))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = frozen(table.where(drawn).repartitionByRange(*order).withColumn(
        "_bucket", F.spark_partition_id().cast("long")), "drawn")
    ranks = exact_rank(ranges, order, "place")
    return (ranks.select(*columns, (F.col("place") + 1).cast("bigint").alias("rank"))
            .unionByName(table.where(~drawn).select(
                *columns, F.lit(None).cast("bigint").alias("rank"))))
