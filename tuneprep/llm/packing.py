"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Method: fill a bin greedily with the largest piece that fits; then replace its smallest piece by
two unpacked pieces that fit the gap so expanded more tightly. Only lengths matter for that, so
it runs over a histogram of at most ``capacity`` lengths: a bin's choice stays the same until a
length runs short, so each distinct bin is made once with its number of repetitions. There are
at most about capacity * ln(capacity) distinct bins for any size of input. Pieces then find their
bins by their number within their length; nothing else passes the driver.

Pieces are numbered within a length per written file first; a cumulative sum of file totals per
length gives the global number, so no length is gathered in one task.

Defined results: a null or empty text is one piece, the end mark alone; repeated rows and ties
are packed each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, map_with_ids, plain_columns
from tuneprep.llm.tokens import encoder

END_MARK = b"\0\0\0\0"


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of one document; only the first may be short."""
    total = len(ids) // 4
    first = total % capacity or capacity
    if total <= capacity:
        return [(0, total)]
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def pieces(docs: DataFrame, capacity: int, path: str | None, doc_id: str,
           text: str) -> DataFrame:
    """One row per piece, written once: id, piece, start, length, crc of its ids, file number."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for batch in batches:
            rows = []
            for key, value in zip(batch["doc_id"], batch["text"]):
                ids = encode(value or "") + END_MARK
                rows += [(key, n, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))
                         for n, (start, length) in enumerate(pieces_of(ids, capacity))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    base = plain_columns(docs, {"doc_id": doc_id, "text": text})
    cut = map_with_ids(
        base, run, "doc_id", "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return frozen(cut.withColumn("file", F.spark_partition_id()), "pieces")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths) of the distinct bins for the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)

    def largest(limit: int, taken: dict[int, int]) -> int | None:
        """The largest length up to the limit of which a piece is left."""
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and left[lengths[at]] <= taken.get(lengths[at], 0):
            at -= 1
        return lengths[at] if at >= 0 else None

    def best_two(least: int, limit: int, taken: dict[int, int]) -> tuple[int, int] | None:
        """Two unpacked pieces with the largest sum in (least, limit]."""
        best, sum_of = None, least
        for big in reversed(lengths[:bisect_right(lengths, limit - 1)]):
            if 2 * big <= sum_of:
                break
            free = left[big] - taken.get(big, 0)
            if free <= 0:
                continue
            other = largest(min(limit - big, big), {**taken, big: taken.get(big, 0) + 1})
            if other is not None and big + other > sum_of:
                best, sum_of = (big, other), big + other
                if sum_of == limit:
                    break
        return best

    bins = []
    while lengths:
        chosen, gap, taken = [], capacity, {}
        while gap and (n := largest(gap, taken)) is not None:
            chosen.append(n)
            taken[n] = taken.get(n, 0) + 1
            gap -= n
        if gap and len(chosen) > 1:
            small = chosen[-1]
            taken[small] -= 1
            if two := best_two(small, gap + small, taken):
                chosen[-1:] = two
        need: dict[int, int] = {}
        for n in chosen:
            need[n] = need.get(n, 0) + 1
        times = min(left[n] // k for n, k in need.items())
        bins.append((times, chosen))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
    return bins


def slots(bins: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Ranges of piece numbers per length: which bin and where in it a piece goes.

    A range holds ``times`` pieces of one length at one place of a distinct bin.
    """
    used: dict[int, int] = {}
    rows, first = [], 0
    for times, lengths in bins:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        first += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "bin", "offset"), table.T))


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, capacity, path, doc_id, text)
    per_file = frozen(cut.groupBy("length", "file").agg(F.count("*").alias("n")), "lengths")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in per_file.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}
    table = slots(plan_bins(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("file").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = per_file.select(F.col("length").alias("_length"), F.col("file").alias("_file"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "file").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = (numbered.join(bases, (F.col("length") == F.col("_length"))
                            & (F.col("file") == F.col("_file")))
              .withColumn("rank", F.col("rank") + F.col("base")).drop("_length", "_file", "base"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        edges = np.searchsorted(t["length"], np.arange(capacity + 2))
        for batch in batches:
            at = np.zeros(len(batch), dtype=np.int64)
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for n in np.unique(length):
                lo, hi = edges[n], edges[n + 1]
                mine = length == n
                at[mine] = lo + np.searchsorted(t["rank"][lo:hi], rank[mine], side="right") - 1
            yield batch.drop(columns=["rank", "file"]).assign(
                sequence_id=t["bin"][at] + rank - t["rank"][at], offset=t["offset"][at])

    return map_with_ids(
        ranked, place, "doc_id", "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint")
