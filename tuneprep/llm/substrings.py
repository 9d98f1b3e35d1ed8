"""Substring de-duplication of word windows with a count-min prefilter.

Method: every task sketches the window counts of its rows; the sketches are merged, part by part,
into one that overestimates every count; a second pass groups exactly (by a 96-bit hash of the
words) only the windows estimated to occur twice or more, so none is lost.

A sketch cell only has to tell "never, once, more often". Tasks send sorted cell numbers as
compressed differences; each part of the cells is merged by a stream with bounded memory, and what
is kept of it is one bit per cell. The bits are broadcast: two rows of at most 2**``max_bits``
cells, whatever the input. Larger inputs take several rounds, each over one class of hashes with a
sketch of its own, so the share of false estimates does not grow with the input.

Before the shuffle of the second pass, each piece of a batch keeps one row per window, that of its
smallest id; its other rows are known to repeat already. So a window that a third of all documents
share is one row per piece, not a hot group. The grouping itself streams over sorted rows.

Texts stay in Arrow's buffers. Words are held as objects for ``CHUNK_WORDS`` words at a time, and
hashes for ``PIECE_WORDS``, so a task's memory does not follow the number of words in a batch.

Defined results: a null text has no words; rows without an id come after all ids; rows with the
same id never remove each other's words; repeated rows get equal results; texts shorter than a
window are kept whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, plain_columns, with_default

PARTS = 256                 # parts per sketch row
BYTES_PER_WORD = 6
CHUNK_WORDS = 1 << 17
PIECE_WORDS = 1 << 22
OUT_BYTES = 8 << 20         # of texts in an output batch
LAST_ID = (1 << 63) - 1
ROW_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
M1, M2 = np.uint64(0x100000001B3), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def hashed_windows(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, ...]:
    """(h1, h2, text number, position) of all windows of the word lists."""
    import xxhash
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    total = int(lengths.sum())
    count = total - size + 1
    if count <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.int32), none, none
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w) for text in texts for w in text), np.uint64, total)
    number = np.repeat(np.arange(len(texts)), lengths)
    inside = np.flatnonzero(number[:count] == number[size - 1:])
    first, second = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    for k in range(size):
        part = words[k:k + count]
        first = first * M1 + part
        second = second * M2 + (part ^ (part >> np.uint64(31)))
    begins = np.cumsum(lengths) - lengths
    number = number[inside]
    return (_mixed(first[inside]), (_mixed(second[inside]) >> np.uint64(32)).astype(np.uint32)
            .view(np.int32), number, inside - begins[number])


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Word lists of successive texts, about ``CHUNK_WORDS`` words at a time, with their start."""
    start, held, words = 0, [], 0
    for at, text in enumerate(texts):
        held.append(text.as_buffer().to_pybytes().split())
        words += len(held[-1])
        if words >= CHUNK_WORDS:
            yield start, held
            start, held, words = at + 1, [], 0
    if held:
        yield start, held


def pieces(found: Iterator[tuple[np.ndarray, ...]], words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Successive arrays joined to pieces of about ``words`` entries of the first column."""
    held: list[tuple[np.ndarray, ...]] = []
    total = 0
    for columns in found:
        held.append(columns)
        total += len(columns[0])
        if total >= words:
            yield tuple(map(np.concatenate, zip(*held)))
            held, total = [], 0
    if total:
        yield tuple(map(np.concatenate, zip(*held)))


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mixed(hashes * ROW_FACTORS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _packed(sorted_cells: np.ndarray) -> bytes:
    """Differences of sorted numbers, byte by byte, compressed."""
    steps = np.diff(sorted_cells, prepend=sorted_cells.dtype.type(0))
    return zlib.compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def sketch(base: DataFrame, size: int, bits: int, classes: int, turn: int) -> dict[int, np.ndarray]:
    """Bits per sketch row: whether a cell was met twice or more."""
    span = max(1, (1 << bits) // PARTS)

    def cells(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        for _, words in chunks(texts):
            h1, h2, _, _ = hashed_windows(words, size)
            if classes > 1:
                h1 = h1[h2.view(np.uint32) % classes == turn]
            yield cells_of(h1, 0, bits), cells_of(h1, 1, bits)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in pieces(cells(batch.column("text")), PIECE_WORDS):
                for row, numbers in enumerate(found):
                    numbers.sort()
                    parts = numbers // np.uint32(span)
                    cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1
                    numbers %= np.uint32(span)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row * PARTS + parts[np.concatenate([[0], cuts])].astype(np.int64)),
                        pa.array([_packed(c) for c in np.split(numbers, cuts)], pa.binary())],
                        ["part", "data"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, once, twice = None, None, None
        for batch in batches:
            for part, data in zip(batch["part"], batch["data"]):
                if part != now:
                    if now is not None:
                        yield pd.DataFrame({"part": [now], "data": [np.packbits(twice).tobytes()]})
                    now, once, twice = part, np.zeros(span, bool), np.zeros(span, bool)
                cells = _unpacked(data)
                twice[cells[1:][cells[1:] == cells[:-1]]] = True
                twice[cells] |= once[cells]
                once[cells] = True
        if now is not None:
            yield pd.DataFrame({"part": [now], "data": [np.packbits(twice).tobytes()]})

    parts = (base.select("text").mapInArrow(local, "part bigint, data binary")
             .repartition("part").sortWithinPartitions("part")
             .mapInPandas(merged, "part bigint, data binary"))
    width = (span + 7) // 8
    rows = {row: np.zeros((PARTS, width), np.uint8) for row in (0, 1)}
    for got in parts.toLocalIterator():      # 2 * 2**bits bits in all
        row, part = divmod(got["part"], PARTS)
        rows[row][part] = np.frombuffer(got["data"], np.uint8)
    return rows


def repeated(base: DataFrame, size: int, bits: int, classes: int, turn: int) -> DataFrame:
    """(id, spot): the windows (first hash) of a document that start in one with a smaller id."""
    shared = base.sparkSession.sparkContext.broadcast(sketch(base, size, bits, classes, turn))
    span = max(1, (1 << bits) // PARTS)

    def met_twice(hashes: np.ndarray) -> np.ndarray:
        hit = np.ones(len(hashes), bool)
        for row, table in shared.value.items():
            part, cell = np.divmod(cells_of(hashes, row, bits), np.uint32(span))
            byte = table[part, cell >> np.uint32(3)]
            hit &= (byte >> (np.uint8(7) - (cell & np.uint32(7)).astype(np.uint8))) & 1 == 1
        return hit

    def windows(ids: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        for start, words in chunks(texts):
            h1, h2, number, _ = hashed_windows(words, size)
            keep = met_twice(h1)
            if classes > 1:
                keep &= h2.view(np.uint32) % classes == turn
            yield h1[keep].view(np.int64), h2[keep], ids[start + number[keep]]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for h1, h2, doc in pieces(windows(ids, batch.column("text")), PIECE_WORDS // 4):
                order = np.lexsort((doc, h2, h1))
                h1, h2, doc = h1[order], h2[order], doc[order]
                new, again = np.ones(len(h1), bool), np.zeros(len(h1), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                again[1:] = ~new[1:] & (doc[1:] == doc[:-1])
                first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                known = doc > first
                # One row per window and piece goes to its place; the others are dealt evenly.
                key = np.where(known, _mixed((h1 ^ doc).view(np.uint64)).view(np.int64), h1)
                columns = {"known": known, "h1": key, "h2": h2, "id": doc,
                           "spot": np.where(known, h1, 0)}
                yield pa.RecordBatch.from_pydict({k: pa.array(v[~again]) for k, v in columns.items()})

    def resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            known = batch["known"].to_numpy()
            h1, h2, doc = (batch[c].to_numpy() for c in ("h1", "h2", "id"))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (known[1:] != known[:-1])
            if last is not None and (known[0], h1[0], h2[0]) == last[0]:
                new[0] = False
            number = np.cumsum(new)
            firsts = np.concatenate([[last[1] if last else 0], doc[new]])
            out = known | (doc > firsts[number])
            last = ((known[-1], h1[-1], h2[-1]), firsts[number[-1]])
            spot = np.where(known, batch["spot"].to_numpy(), h1)
            yield pd.DataFrame({"id": doc[out], "spot": spot[out]})

    rows = base.mapInArrow(suspects, "known boolean, h1 bigint, h2 int, id bigint, spot bigint")
    return (rows.repartition("h1", "h2").sortWithinPartitions("known", "h1", "h2", "id")
            .mapInPandas(resolved, "id bigint, spot bigint"))


def without_repeats(docs: DataFrame, size: int = 13, max_bits: int = 29, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, and the ``kept`` words joined by spaces."""
    base = plain_columns(docs, {"doc_id": doc_id, "text": text}).select(
        "doc_id", with_default(F.col("text")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"))
    size_of = base.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    words = max(1, size_of // BYTES_PER_WORD)
    bits = min(max_bits, max(16, math.ceil(math.log2(words))))
    classes = math.ceil(words / (1 << max_bits))
    inputs = base.select("id", "text")
    found = repeated(inputs, size, bits, classes, 0)
    for turn in range(1, classes):
        found = found.union(repeated(inputs, size, bits, classes, turn))
    spots = frozen(found.groupBy("id").agg(F.collect_list("spot").alias("spots")), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sizes, removed, kept, held = 0, [], [], [], 0

            def out(end: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, end - start), pa.array(sizes, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"])

            for at, (value, marks) in enumerate(zip(batch.column("text"), batch.column("spots"))):
                words = value.as_buffer().to_pybytes().split()
                sizes.append(len(words))
                if marks.is_valid and len(marks):
                    words = uncovered(words, marks.values.to_numpy())
                removed.append(sizes[-1] - len(words))
                kept.append(b" ".join(words))
                held += len(kept[-1])
                if held >= OUT_BYTES:
                    yield out(at + 1)
                    start, sizes, removed, kept, held = at + 1, [], [], [], 0
            if sizes:
                yield out(batch.num_rows)

    def uncovered(words: list[bytes], marks: np.ndarray) -> list[bytes]:
        h1, _, _, at = hashed_windows([words], size)
        at = at[np.isin(h1.view(np.int64), marks)]
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, np.minimum(at + size, len(words)), -1)
        return [w for w, k in zip(words, np.cumsum(edges)[:-1] == 0) if k]

    marked = base.join(spots, "id", "left").select("doc_id", "text", "spots")
    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
