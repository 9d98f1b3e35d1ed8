"""Prediction samples of training logs, assembled from line rows.

A sample is ``predict_<step>`` followed by the quoted values of the keys ``input``, ``predict`` and
``label``, with any text and any number of lines in between. Finding samples is a left-to-right
scan with ten states (before a sample; and for each key: before it, between key and value, inside
the value). No task sees a whole log:

1. every line becomes the few tokens the scan can react to (keys, quotes, sample starts, blanks);
   lines without any yield no row, and no text is moved;
2. the tokens of a block of ``width`` line positions are reduced, for each state the scan may enter
   with, to the state it leaves with, the positions of the open sample and of the last ``keep``
   complete ones;
3. a log's block rows are composed in order, one row at a time, from the scan's first state;
4. only the lines inside the kept values are fetched, by (log, block), and joined to texts.

Defined results: ``ord`` is the line's position from 0 and unique in its log; a missing position
only matters between a key and its value, which it parts; null lines are empty lines; rows with a
null or negative ``ord`` are left out; a null ``log_id`` is a log of its own; a sample that does not end is no
sample, and neither is anything after its start; texts of any length are whole unless ``limits``
cuts them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.rules.terms import SAMPLE_LIMITS
from tuneprep.session import scratch_path

WIDTH = 65_536
BROADCAST_SPANS = 200_000       # rows of about 100 bytes; more are merge joined
KEYS = list(SAMPLE_LIMITS)
SPACE = r"[ \t\n\x0b\f\r]"
TOKEN = re.compile(rf'predict_([0-9]+)|"(?=(?:({"|".join(KEYS)})":{SPACE}*("|\Z))?)')
START, QUOTE, BLANK = 0, 4, 8   # 1-3: key and opening quote; 5-7: key at the end of its line
STATES = 1 + 3 * len(KEYS)      # 0: before a sample; 3k-2, 3k-1, 3k: before, inside, at key k


def tokens(line: str) -> Iterator[tuple[int, int, int, bool, str | None]]:
    """(start, end, kind, whether only space is before it, step) of each token of a line."""
    if not line.strip(" \t\n\x0b\f\r"):
        yield 0, 0, BLANK, False, None
        return
    for m in TOKEN.finditer(line):
        if m[1]:
            yield m.start(), m.end(), START, False, m[1]
        else:
            key = KEYS.index(m[2]) + 1 if m[2] else 0
            end, kind = (m.end(3), key if m[3] else QUOTE + key) if key else (m.end(), QUOTE)
            yield m.start(), end, kind, not line[:m.start()].strip(" \t\n\x0b\f\r"), None


class Scan:
    """The scan from one state: fields of the open sample, and the last complete samples.

    Fields are the step and (ord, offset) of each value's start and end; those found before the
    block are None.
    """

    def __init__(self, state: int, first: int, keep: int):
        self.state, self.keep = state, keep
        self.at, self.waited = (first, 0), first - 1
        self.fields: list = [None] * (1 + 2 * len(KEYS))
        self.done: list[list] = []

    def key(self) -> tuple:
        return self.state, self.at, self.waited, self.fields, self.done

    def take(self, ord_: int, start: int, end: int, kind: int, leading: bool, step) -> bool:
        """React to a token; True if it completed a sample."""
        waiting = self.state and self.state % 3 == 0
        if kind == BLANK:
            if waiting and self.waited == ord_ - 1:
                self.waited = ord_
            return False
        if (ord_, start) < self.at:
            return False
        if waiting:
            if leading and self.waited == ord_ - 1:
                self._open(self.state // 3, (ord_, start + 1))
                return False
            self.state -= 2
        part, key = self.state % 3, (self.state + 2) // 3
        if self.state == 0:
            if kind == START:
                self.state, self.at = 1, (ord_, end)
                self.fields = [step] + [None] * (2 * len(KEYS))
        elif part == 1:
            if kind == key:
                self._open(key, (ord_, end))
            elif kind == QUOTE + key:
                self.state, self.at, self.waited = 3 * key, (ord_, end), ord_
        elif kind != START:
            self.fields[2 * key], self.at = (ord_, start), (ord_, start + 1)
            self.state = 3 * key + 1
            if key == len(KEYS):
                self.state, self.done = 0, [*self.done, list(self.fields)][-self.keep:]
                return True
        return False

    def _open(self, key: int, at: tuple[int, int]) -> None:
        self.state, self.at, self.fields[2 * key - 1] = 3 * key - 1, at, at

    def leave(self, last: int) -> list:
        """(state, open fields, complete samples) after the block's last position."""
        lost = self.state and self.state % 3 == 0 and self.waited != last
        return [self.state - 2 if lost else self.state, self.fields, self.done]


def reduced(rows: Iterator[tuple], block: int, width: int, keep: int) -> str:
    """What a block's tokens do to each state. Scans that have become equal go on as one.

    The first block of a log can only be entered with the first state.
    """
    place = list(range(STATES if block else 1))
    scans = [Scan(state, block * width, keep) for state in place]
    for token in rows:
        if sum([scan.take(*token) for scan in scans]) and len(scans) > 1:
            kept: list[Scan] = []
            moved = []
            for scan in scans:
                same = next((i for i, k in enumerate(kept) if k.key() == scan.key()), len(kept))
                kept += [scan] * (same == len(kept))
                moved.append(same)
            scans, place = kept, [moved[i] for i in place]
    return json.dumps([place, [scan.leave((block + 1) * width - 1) for scan in scans]])


def composed(blocks: Iterator[tuple[int, str]], keep: int) -> list[list]:
    """The last samples of a log from its blocks' reductions in order."""
    state, fields, done, before = 0, [None] * (1 + 2 * len(KEYS)), [], None
    for block, text in blocks:
        if state and state % 3 == 0 and before != block - 1:
            state -= 2
        place, scans = json.loads(text)
        state, opened, found = scans[place[state]]
        done = [*done, *[[x if x is not None else y for x, y in zip(s, fields)] for s in found]][-keep:]
        fields = [x if x is not None else y for x, y in zip(opened, fields)]
        before = block
    return done


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def sample_spans(lines: DataFrame, keep: int = 3, width: int = WIDTH) -> DataFrame:
    """(log_id, n, step, key, start_ord, start_at, end_ord, end_at) of the last samples' values."""
    kind = lines.schema["log_id"].dataType
    log = pa.field("log_id", pa.string() if kind.simpleString() == "string" else pa.int64())
    text = F.coalesce("line", F.lit(""))
    wanted = (F.contains(text, F.lit('"')) | F.contains(text, F.lit("predict_"))
              | (F.btrim(text, F.lit(" \t\n\x0b\f\r")) == ""))
    token = pa.schema([log, ("block", pa.int64()), ("ord", pa.int64()), ("start", pa.int32()),
                       ("end", pa.int32()), ("kind", pa.int32()), ("leading", pa.bool_()),
                       ("step", pa.string())])
    summary = pa.schema([log, ("block", pa.int64()), ("scans", pa.string())])
    span = pa.schema([log, ("n", pa.int64()), ("step", pa.string()), ("key", pa.string()),
                      *[(f"{end}_{part}", pa.int64()) for end in ("start", "end") for part in ("ord", "at")]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((log_id, ord_ // width, ord_, *t) for log_id, ord_, line in _rows(batches)
                             for t in tokens(line)), token, 10_000)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_rows(batches), itemgetter(0, 1))
        yield from _batches(((log_id, block, reduced((row[2:] for row in rows), block, width, keep))
                             for (log_id, block), rows in groups), summary, 1000)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((
            (log_id, n, sample[0], key, *sample[2 * i + 1], *sample[2 * i + 2])
            for log_id, rows in groupby(_rows(batches), itemgetter(0))
            for n, sample in enumerate(composed((row[1:] for row in rows), keep))
            for i, key in enumerate(KEYS)), span, 1000)

    def ddl(schema: pa.Schema) -> str:
        names = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string"}
        return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)

    found = lines.where(wanted & (F.col("ord") >= 0)).select(
        "log_id", F.col("ord").cast("bigint").alias("ord"), text.alias("line")).mapInArrow(
            find, ddl(token))
    # A set number of partitions: tokens are small, so merging them by size would leave few tasks.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = found.repartition(parts, "log_id", "block").sortWithinPartitions(
        "log_id", "block", "ord", "start").mapInArrow(reduce, ddl(summary))
    return blocks.repartition(parts, "log_id").sortWithinPartitions("log_id", "block").mapInArrow(
        compose, ddl(span))


def sample_texts(lines: DataFrame, spans: DataFrame, limits: dict[str, int] | None = None,
                 width: int = WIDTH) -> DataFrame:
    """(log_id, n, step, input, predict, label) with the texts of the spans."""
    blocks = F.explode(F.sequence(F.floor(F.col("start_ord") / width), F.floor(F.col("end_ord") / width)))
    spark, path = spans.sparkSession, scratch_path(spans.sparkSession, "spans")
    spans.withColumn("block", blocks).withColumnRenamed("log_id", "log").write.parquet(path)
    wanted = spark.read.parquet(path)
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_SPANS else wanted.hint("merge")
    rows = lines.select("log_id", F.col("ord").cast("bigint").alias("ord"),
                        F.coalesce("line", F.lit("")).alias("line"))
    met = rows.join(wanted, F.col("log_id").eqNullSafe(F.col("log"))
                    & (F.floor(F.col("ord") / width) == F.col("block"))
                    & F.col("ord").between(F.col("start_ord"), F.col("end_ord")))
    first = F.when(F.col("ord") == F.col("start_ord"), F.col("start_at")).otherwise(0).cast("int")
    last = F.when(F.col("ord") == F.col("end_ord"), F.col("end_at")).otherwise(F.length("line")).cast("int")
    pieces = met.select("log_id", "n", "step", "key", "ord",
                        F.substring("line", first + 1, last - first).alias("piece"))

    def value(key: str):
        parts = F.array_sort(F.collect_list(F.when(F.col("key") == key, F.struct("ord", "piece"))))
        text = F.array_join(F.transform(parts, lambda p: p["piece"]), "\n")
        return (F.substring(text, 1, limits[key]) if limits and key in limits else text).alias(key)

    return pieces.groupBy("log_id", "n", "step").agg(*[value(key) for key in KEYS])


def sample_outputs(lines: DataFrame, keep: int = 3, limits: dict[str, int] | None = None,
                   width: int = WIDTH) -> DataFrame:
    """Last prediction samples of each log from (log_id, ord, line), numbered from 0 in log order.

    ``operators.monitor.sample_outputs`` does the same for logs that are one text each.
    """
    return sample_texts(lines, sample_spans(lines, keep, width), limits, width)
