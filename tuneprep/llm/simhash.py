"""SimHash near-duplicates with a covering code as anchors.

Fingerprints of 64 bits link at 3 or fewer differing bits. Two halves of 31 bits (bits 0-30 and
31-61; bits 62 and 63 belong to no half) cannot both differ in two bits, so one half differs in
at most one. For a half, the codewords of the binary Hamming code (31, 26) are the anchors: a
perfect code, so every value lies within its covering radius of 1 of exactly one anchor. A
fingerprint is replicated to every anchor within 1 + 1 bits (16 on average); the value of a
linked partner lies within 1 bit of its own anchor, so both meet there, and each linked pair is
compared at some anchor.

Equal fingerprints are one row before replication. The rows of one anchor are compared in blocks
with packed integers; they yield a spanning forest instead of all pairs, so the output is linear
in the rows. A crowded anchor is split by parts of the other half: of four parts of the remaining
bits at least one is equal for a linked pair, so no link is lost.

Defined results: a null or empty text has no words and fingerprint zero, which links like any
other; repeated rows and ties stay rows of their own with one component; null ids never are a
component's smallest id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, map_with_ids, plain_columns
from tuneprep.llm.components import components

HALF = 31
HALF_MASK = (1 << HALF) - 1
MAX_DISTANCE = 3
CROWDED = 4096          # rows of an anchor that are compared as one block of 16 M pairs
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles (XXH64, seed 42, over UTF-8)."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), CHUNK):
        part = grams[at:at + CHUNK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row; ``fp`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"],
                                "fp": values.view(np.int64)})

    base = plain_columns(docs, {"doc_id": doc_id, "text": text}).withColumn(
        "text_hash", F.xxhash64("text"))
    return map_with_ids(base, run, "doc_id", "doc_id {}, text_hash bigint, fp bigint")


def _syndrome(values: np.ndarray) -> np.ndarray:
    """Position (1..31) of the bit that is off the Hamming codeword, or 0."""
    out = np.zeros(values.shape, dtype=np.uint64)
    for position in range(1, HALF + 1):
        bit = (values >> np.uint64(position - 1)) & np.uint64(1)
        out ^= bit * np.uint64(position)
    return out


def _nearest(values: np.ndarray) -> np.ndarray:
    """The anchor within one bit of each 31-bit value."""
    where = _syndrome(values)
    flip = np.left_shift(np.uint64(1), np.maximum(where, np.uint64(1)) - np.uint64(1))
    return values ^ np.where(where > 0, flip, np.uint64(0))


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within two bits of each value."""
    flips = np.concatenate([[0], 1 << np.arange(HALF, dtype=np.uint64)]).astype(np.uint64)
    found = np.sort(_nearest(half[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, _ = np.nonzero(new)
    return rows, found[new]


def replicate(fps: DataFrame) -> DataFrame:
    """(anchor, fp) rows; the anchor's bit 31 tells the half."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy().view(np.uint64)
            for half in (0, 1):
                part = (values >> np.uint64(HALF * half)) & np.uint64(HALF_MASK)
                rows, anchors = anchors_of(part)
                keys = anchors.astype(np.int64) | (half << HALF)
                yield pd.DataFrame({"anchor": keys, "fp": values[rows].view(np.int64)})

    return fps.select("fp").mapInPandas(run, "anchor bigint, fp bigint")


def spanning_links(values: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a > b) that connect what pairs within the distance connect.

    Each unvisited value starts a component, and its members pull in their neighbours among the
    values not yet reached; every value is compared with the unreached ones once, and each
    reached value yields one link.
    """
    rest = np.unique(values)
    a, b = [], []
    while len(rest) > 1:
        seeds, rest = rest[:1], rest[1:]
        while len(seeds) and len(rest):
            seed, seeds = seeds[0], seeds[1:]
            near = np.bitwise_count((rest ^ seed).view(np.uint64)) <= max_distance
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.maximum(found, seed))
                b.append(np.minimum(found, seed))
                seeds = np.concatenate([seeds, found])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _link_groups(batches: Iterator[pd.DataFrame], max_distance: int) -> Iterator[pd.DataFrame]:
    """Links of rows that come sorted by (k1, k2); a group may span batches."""
    left = None
    for batch in batches:
        table = batch[["k1", "k2", "fp"]].to_numpy(dtype=np.int64)
        table = table if left is None else np.concatenate([left, table])
        change = np.flatnonzero((table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1])) + 1
        if not len(change):
            left = table
            continue
        left = table[change[-1]:]
        yield _links_between(table[:change[-1]], change[:-1], max_distance)
    if left is not None:
        yield _links_between(left, np.zeros(0, dtype=np.int64), max_distance)


def _links_between(table: np.ndarray, change: np.ndarray, max_distance: int) -> pd.DataFrame:
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(table)]])
    fps = table[:, 2]
    found = [spanning_links(fps[s:e], max_distance) for s, e in zip(starts, ends) if e - s > 2]
    two = starts[ends - starts == 2]
    x, y = fps[two], fps[two + 1]
    near = (np.bitwise_count((x ^ y).view(np.uint64)) <= max_distance) & (x != y)
    found.append((np.maximum(x, y)[near], np.minimum(x, y)[near]))
    return pd.DataFrame({"a": np.concatenate([f[0] for f in found]),
                         "b": np.concatenate([f[1] for f in found])})


def _parts(fp, half) -> list:
    """Four parts of the 33 bits outside the anchor's half, each with its number in front."""
    low = F.shiftrightunsigned(fp, HALF)                       # half 0: bits 31..63
    high = (fp.bitwiseAND(HALF_MASK)).bitwiseOR(               # half 1: bits 0..30, 62, 63
        F.shiftleft(F.shiftrightunsigned(fp, 2 * HALF), HALF))
    rest = F.when(half == 0, low).otherwise(high)
    cuts = [(0, 8), (8, 8), (16, 8), (24, 9)]
    return [F.shiftrightunsigned(rest, at).bitwiseAND((1 << width) - 1) + F.lit((i + 1) << 10)
            for i, (at, width) in enumerate(cuts)]


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a > b) that connect the distinct fingerprints ``fp`` within ``max_distance`` bits."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"max_distance must be 0 to {MAX_DISTANCE}")
    rows = frozen(replicate(fps), "anchors")
    crowded = frozen(rows.groupBy("anchor").agg(F.count("*").alias("n"))
                     .where(F.col("n") > CROWDED).select(F.col("anchor").alias("full")), "crowded")
    half = F.shiftright("anchor", HALF)
    met = (rows.join(crowded, rows["anchor"] == crowded["full"], "left")
           .select(F.col("anchor").alias("k1"), "fp", F.explode(F.when(
               F.col("full").isNotNull(), F.array(*_parts(F.col("fp"), half))).otherwise(
                   F.array(F.lit(0).cast("long")))).alias("k2"))
           .repartition("k1", "k2").sortWithinPartitions("k1", "k2"))
    return met.mapInPandas(lambda batches: _link_groups(batches, max_distance),
                           "a bigint, b bigint").distinct()


def linked(docs: DataFrame, shingle: int = 3, max_distance: int = MAX_DISTANCE,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per input row.

    ``root`` is a fingerprint that names the component, ``component_id`` the smallest id in it.
    """
    rows = frozen(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    distinct = frozen(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fp")
    roots = frozen(components(links(distinct, max_distance)), "roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = frozen(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "root",
                                                       "component_id"), "classes")
    return rows.join(classes, rows["fp"] == classes["_fp"]).drop("_fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = MAX_DISTANCE,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``max_distance`` bits.
    """
    return linked(docs, shingle, max_distance, doc_id, text).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The input rows without near copies: of each component one row stays, with all its columns.

    It is the row with the smallest id (null ids last), and the smallest text hash among rows of
    that id; of equal rows one. Rows that share an id without being near copies all stay.
    """
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    keep = linked(docs, shingle, max_distance).groupBy("root").agg(F.min(place).alias("k"))
    # Plain values as keys: the join's shuffle then serves the ranking of equal rows as well.
    names = {"_no_id": "k.z", "_named": "k.doc_id", "_hash_of": "k.text_hash"}
    kept = keep.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{n}_kept")
                         for n, c in names.items()]).distinct()
    own = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(
        names, (F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")))})
    met = own.join(kept.hint("merge"), [own[n] == kept[f"{n}_kept"] for n in names])
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    return met.withColumn("_rank", rank).where("_rank = 1").select(
        *[F.col(f"`{c}`") for c in docs.columns])
