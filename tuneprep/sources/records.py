"""Records that span lines, read from one file by many tasks.

A file is cut by Spark's text reader at a separator that every record holds (``}`` in a JSON
array, a line break in CSV), so blocks of one file go to different tasks and no task holds a
file. What a fragment means depends on where the scan stands: inside a string or quoted field,
and how deep. Therefore:

1. each block is reduced to what it does to either state it may start in (the state it ends in,
   and the change of depth): one small row a block;
2. these rows are composed in file order to the state that each block really starts in;
3. a second scan with these states cuts the blocks into records. The piece of a record that a
   block starts or ends with is handed over, and the pieces are joined in block order.

The scans read their rows in file order as they come, without a shuffle. The states are broadcast
below a counted ``BROADCAST_BLOCKS`` (25 TB of blocks of 128 MB) and merge joined above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.session import scratch_path

BROADCAST_BLOCKS = 200_000
ROWS = 2_000


class JsonArray:
    """Objects of a top-level array; other elements are skipped. State: in a string, depth.

    Of a file that is cut off, the objects before the cut are read.
    """

    separator = "}"
    closing = "}"
    token = re.compile(r'\\.|["{}\[\]]', re.S)

    def step(self, inside: int, depth: int, text: str) -> tuple[int, int, int | None, bool]:
        """(inside, depth, start of the object that begins here, whether one ends) after a fragment."""
        start = None
        for m in self.token.finditer(text + "}"):
            c = m[0]
            if c == '"':
                inside = 1 - inside
            elif inside or len(c) > 1:
                continue
            elif c in "{[":
                if depth == 1 and c == "{":
                    start = m.start()
                depth += 1
            else:
                depth -= 1
        return inside, depth, start, not inside and depth == 1

    def opened(self, inside: int, depth: int) -> bool:
        return depth > 1


class CsvRows:
    """Rows of CSV with doubled quotes. State: in a quoted field; depth is not used."""

    separator = "\n"
    closing = ""

    def step(self, inside: int, depth: int, text: str) -> tuple[int, int, int | None, bool]:
        start = None if inside else 0
        if '"' in text:
            inside = self._inside(inside, text)
        return inside, depth, start, not inside

    def _inside(self, inside: int, text: str) -> int:
        """Whether the line ends within a quoted field; only a field's first character opens one."""
        at = 0
        while True:
            if inside or text.startswith('"', at):
                at += 0 if inside else 1
                while (at := text.find('"', at) + 1) and text.startswith('"', at):
                    at += 1
                if not at:
                    return 1
                inside = 0
            at = text.find(",", at) + 1
            if not at:
                return 0

    def opened(self, inside: int, depth: int) -> bool:
        return bool(inside)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


EFFECT = pa.schema([("file", pa.string()), ("block", pa.int64()), *[
    (f"{name}{k}", pa.int64()) for k in (0, 1) for name in ("inside", "change")]])
STATE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.int64()), ("depth", pa.int64())])
PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int64()),
                   ("ends", pa.bool_()), ("first", pa.bool_()), ("value", pa.string())])
RECORD = pa.schema([("first", pa.bool_()), ("value", pa.string())])
HEAD, WHOLE, TAIL = 0, 1, 2     # the rest of an open record; a record; a record that stays open


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def effects(kind, rows: Iterator[tuple]) -> Iterator[tuple]:
    """What each block does to either starting state."""
    for (file, block), group in groupby(rows, itemgetter(0, 1)):
        ends = [(0, 0), (1, 0)]
        for row in group:
            ends = [kind.step(*end, row[2])[:2] for end in ends]
        yield file, block, *ends[0], *ends[1]


def states(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The state each block starts in; rows come by file and block."""
    for file, group in groupby(rows, itemgetter(0)):
        inside = depth = 0
        for _, block, *after in group:
            yield file, block, inside, depth
            inside, depth = after[2 * inside], depth + after[2 * inside + 1]


def pieces(kind, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Records, and the pieces at the ends of blocks, of rows (file, block, text, inside, depth)."""
    for (file, block), group in groupby(rows, itemgetter(0, 1)):
        held: list[str] | None = None
        part, first, begun = WHOLE, False, block > 0
        for n, (_, _, text, inside, depth) in enumerate(group):
            if n == 0:
                now = inside, depth
                if kind.opened(*now):
                    held, part = [], HEAD
            *now, start, ends = kind.step(*now, text)
            if start is not None:
                held, part = [text[start:]], WHOLE
                first = not begun and bool(text.strip())
                begun = begun or first
            elif held is not None:
                held.append(text)
            if ends and held is not None:
                yield file, block, part, True, first, kind.separator.join(held) + kind.closing
                held, first = None, False
        if held is not None:
            yield (file, block, HEAD if part == HEAD else TAIL, False, first,
                   kind.separator.join(held) + kind.separator)


def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Records from the pieces of blocks, which come by file, block and part."""
    for _, group in groupby(rows, itemgetter(0)):
        held: list[str] | None = None
        flag = False
        for _, _, part, ends, first, value in group:
            if part == TAIL:
                held, flag = [value], first
            elif held is not None:
                held.append(value)
                if ends:
                    yield flag, "".join(held)
                    held = None
        if held is not None:
            yield flag, "".join(held)[:-1]  # the file ends within a record, without a separator


def split_records(spark: SparkSession, paths: list[str], kind) -> DataFrame:
    """(first, value): the records of files, ``first`` for the first one of each file.

    Records that lie in one block come in file order, those that blocks cut after them.
    """
    text = spark.read.option("lineSep", kind.separator).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        "value")
    found = text.mapInArrow(lambda b: _batches(effects(kind, _rows(b)), EFFECT), _ddl(EFFECT))
    path = scratch_path(spark, "blocks")
    found.repartition("file").sortWithinPartitions("file", "block").mapInArrow(
        lambda b: _batches(states(_rows(b)), STATE), _ddl(STATE)).write.parquet(path)
    starts = spark.read.schema(_ddl(STATE)).parquet(path)
    if starts.count() <= BROADCAST_BLOCKS:
        stated = text.join(F.broadcast(starts), ["file", "block"])
    else:
        stated = text.withColumn("row", F.monotonically_increasing_id()).join(
            starts.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "row")
    stated = stated.select("file", "block", "value", "inside", "depth")
    cut = scratch_path(spark, "records")
    stated.mapInArrow(lambda b: _batches(pieces(kind, _rows(b)), PIECE), _ddl(PIECE)).write.parquet(cut)
    rows = spark.read.schema(_ddl(PIECE)).parquet(cut)
    glued = rows.where(F.col("part") != WHOLE).repartition("file").sortWithinPartitions(
        "file", "block", "part").mapInArrow(lambda b: _batches(joined(_rows(b)), RECORD), _ddl(RECORD))
    return rows.where(F.col("part") == WHOLE).select("first", "value").union(glued)
