"""A streaming source of our own: the lines of log files that grow while they are read.

``write_logs`` writes a table of lines as such files, one folder per log.

An offset is a listing: length and modification time of every file that matches. A batch reads the
bytes between two listings in ranges of at most ``range_bytes``, so that one big file is read by
many tasks and many small ones by one. A range yields the lines whose line break lies in it, with
the byte position of their start; a line that an earlier listing had half written is looked up
backwards from the range's start and comes whole, once. Nothing is read twice, and nothing but
listings is kept, so a restarted query goes on from its checkpoint.

``written`` is the modification time (microseconds) in the listing that a batch ends at: lines of
a log are ordered by (written, file, position), whether it grows in place or by further files.

Defined results: a last line without a line break waits for it, unless it is a complete JSON or
dictionary object already, which is read at once (what is added to that line later is not read
unless a listing falls between); a file that became shorter is read from its start; a file that is
gone yields nothing more; bytes that are not UTF-8 are replaced; names that start with ``_`` or
``.`` are skipped. Paths are those that Arrow's file systems open (local, ``hdfs://``, ``s3://``,
``gs://``).
"""

from __future__ import annotations

import ast
import fnmatch
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "folder string, written bigint, file string, position bigint, line string"
RANGE_BYTES = 64 << 20
LEAST_BYTES = 1 << 20       # of a task
OPEN_BYTES = 16 << 10       # what opening a file counts as
BLOCK = 1 << 20
ROWS = 10_000


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def closed(text: bytes) -> bool:
    """Whether the text is one complete JSON or dictionary object."""
    body = text.strip()
    if not (body.startswith(b"{") and body.endswith(b"}")):
        return False
    for read in (json.loads, ast.literal_eval):
        try:
            return isinstance(read(body.decode("utf-8", "replace")), dict)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
    return False


def line_start(file: pa.NativeFile, at: int) -> int:
    """Position after the last line break before ``at``."""
    while at:
        begin = max(0, at - BLOCK)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def lines_between(file: pa.NativeFile, first: int, begin: int, end: int,
                  last: bool) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that end in [begin, end).

    The batch starts at ``first`` in this file; ``last`` tells that it ends at ``end``.
    """
    at = position = line_start(file, begin)
    known = -1
    if at < first:
        file.seek(at)
        known = at if closed(file.read(first - at)) else -1  # the batch before has read it
    file.seek(at)
    held: list[bytes] = []
    while at < end and (block := file.read(min(BLOCK, end - at))):
        at += len(block)
        *whole, rest = block.split(b"\n")
        for line in whole:
            line = b"".join([*held, line])
            held = []
            if position != known:
                yield position, line
            position += len(line) + 1
        held += [rest] * bool(rest)
    if last and held and position != known and closed(line := b"".join(held)):
        yield position, line


class Ranges(InputPartition):
    """(path, folder, written, first, begin, end, last) of the ranges of one task."""

    def __init__(self, ranges: list[tuple]):
        super().__init__(ranges)


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int, tasks: int):
        self.path, self.range_bytes, self.tasks = path.rstrip("/"), range_bytes, tasks

    def _system(self, path: str) -> tuple[fs.FileSystem, str]:
        return system_of(path)

    def _matches(self, path: str, wanted: list[str]) -> bool:
        """Whether a file, or its folder, matches the pattern part by part."""
        parts = path.split("/")
        if parts[-1][:1] in ("_", "."):
            return False
        return any(len(p) == len(wanted) and all(map(fnmatch.fnmatchcase, p, wanted))
                   for p in (parts, parts[:-1]))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        parts = self.path.split("/")
        fixed = next((i for i, part in enumerate(parts) if set(part) & set("*?[")), len(parts))
        system, root = self._system("/".join(parts[:fixed]) or "/")
        wanted = root.rstrip("/").split("/") + parts[fixed:]
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {info.path: f"{info.size}:{(info.mtime_ns or 0) // 1000}" for info in found
                if info.is_file and self._matches(info.path, wanted)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        grown = []
        for path, now in sorted(end.items()):
            size, written = map(int, now.split(":"))
            before = int(start[path].split(":")[0]) if path in start else 0
            first = before if before <= size else 0
            if first < size:
                grown.append((path, path.split("/")[-2].rpartition("=")[2], written, first, size))
        total = sum(size - first + OPEN_BYTES for *_, first, size in grown)
        most = min(self.range_bytes, max(LEAST_BYTES, total // self.tasks + 1))
        out: list[Ranges] = []
        held, weight = [], 0
        for path, folder, written, first, size in grown:
            for begin in range(first, size, most):
                end_ = min(size, begin + most)
                if weight + end_ - begin > most and held:
                    out.append(Ranges(held))
                    held, weight = [], 0
                held.append((path, folder, written, first, begin, end_, end_ == size))
                weight += end_ - begin + OPEN_BYTES
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = self._system("/".join(self.path.split("/")[:3]) if "://" in self.path else "/")
        names = [column.split()[0] for column in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for path, folder, written, first, begin, end, last in partition.value:
            name = path.rpartition("/")[2]
            with system.open_input_file(path) as file:
                for position, line in lines_between(file, first, begin, end, last):
                    text = line.removesuffix(b"\r").decode("utf-8", "replace")
                    rows.append((folder, written, name, position, text))
                    if len(rows) == ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)),
                                  int(self.options.get("tasks", 1)))


def growing_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Stream of (folder, written, file, position, line) of the files in the folders at ``path``."""
    spark.dataSource.register(GrowingLines)
    return (spark.readStream.format(FORMAT).option("range_bytes", range_bytes)
            .option("tasks", spark.sparkContext.defaultParallelism).load(path))


def folder_name(key: str, value: str | None) -> str:
    """``<key>=<value>`` as Spark names the folders of a partitioned table."""
    if not value:
        return f"{key}=__HIVE_DEFAULT_PARTITION__"
    return f"{key}=" + re.sub("[\\x00-\\x1f\\x7f\"#%'*/:=?\\\\{\\[\\]^]",
                              lambda found: f"%{ord(found[0]):02X}", value)


def write_logs(lines: DataFrame, path: str, key: str, order: str) -> None:
    """Write lines as ``<path>/<key>=<value>/part-<n>.log``, each partition's in the given order.

    Tasks write the files themselves, one per key and partition, and no driver moves them, so the time
    per file is that of the file system. A file has a hidden name until it is complete; a repeated task
    replaces its files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = system_of(path)
        context = TaskContext.get()
        name, hidden = f"part-{context.partitionId():05d}.log", f"_{context.taskAttemptId()}.log"
        folder, file = None, None

        def close() -> None:
            if file is not None:
                file.close()
                system.move(f"{folder}/{hidden}", f"{folder}/{name}")

        for batch in batches:
            values, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            runs = pc.run_end_encode(values)
            begin = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                at = f"{root}/{folder_name(key, value)}"
                if at != folder:
                    close()
                    folder = at
                    system.create_dir(folder)
                    file = system.open_output_stream(f"{folder}/{hidden}")
                file.write(("\n".join(texts[begin:end].to_pylist()) + "\n").encode())
                begin = end
        close()
        yield from ()

    lines.sortWithinPartitions(key, order).select(key, "line").mapInArrow(write, "written int").write.format(
        "noop").mode("overwrite").save()
