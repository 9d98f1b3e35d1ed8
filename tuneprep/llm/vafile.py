"""Centroid clustering (Lloyd's rounds) over a VA-file.

Vectors become integers (``floor(scale * x)``). Each is approximated by a cell of ``bits`` bits
per dimension and by its distance from the cell's centre, the residual. Cells have equal widths
over the range of a bounded sample; a vector outside of it has a large residual, so intervals hold
whatever was sampled. In each round lookup tables (centroid, dimension, cell) give the cell
centre's squared distance to each centroid, less a term that all centroids share; the residual
makes it an interval. Where one interval lies below all others the cluster is known from the
cells; full vectors are fetched only for rows with overlapping intervals and for rows whose
cluster changed.

A round needs no state but two centroid tables: the clusters of the round before are found by the
same intervals, and only moved vectors change the clusters' sums, which are exact integers. The
first round adds up all vectors. A round writes the numbers of the rows to fetch (8 bytes each),
which are broadcast below a counted ``BROADCAST_ROWS`` and merge joined above. The driver holds
centroids, their sums and ``SAMPLE`` vectors.

Defined results: vectors of another length, null vectors, and vectors with null or non-finite
components (before or after scaling) are left out; fewer rows than clusters give one centroid a
row; a null id hashes as the empty text; repeated ids are rows of their own, ties between equal
hashes go by the components; equal distances go to the smaller cluster; an empty cluster keeps its
centroid; sums have any size, a distance or inertia beyond a long is null; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, plain_columns

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
BITS = 6
SAMPLE = 4096                # vectors the cells' range is taken from
BROADCAST_ROWS = 500_000     # row numbers, 8 bytes each
NARROW = 1 << 26             # up to here squared distances of 64 components fit a long
LIMB = 40                    # sums travel as four limbs of so many bits
LONG_MAX = (1 << 63) - 1


def usable(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Rows whose vector ``v`` has ``dims`` finite components."""
    return vectors.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & (
        F.abs(x.cast("double") * scale) < F.lit(float("inf")))))


def integers(column: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """Rows of whole numbers, as exact doubles."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(scale * flat).reshape(len(column), dims)


def exact(values: np.ndarray, wide: bool) -> np.ndarray:
    """Whole numbers as 64-bit integers, or as Python integers where squares may not fit."""
    if not wide:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


class Cells:
    """Cells of equal width per dimension; a row's cells are packed into ``bits`` bits each."""

    def __init__(self, sample: np.ndarray, bits: int):
        self.bits, self.low = bits, sample.min(axis=0)
        self.width = np.maximum(sample.max(axis=0) - self.low, 1) / (1 << bits)
        self.centres = self.low[:, None] + self.width[:, None] * (np.arange(1 << bits) + 0.5)

    def approximate(self, values: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(packed cells, residual) of each row."""
        cells = np.clip((values - self.low) // self.width, 0, (1 << self.bits) - 1).astype(np.int64)
        away = np.linalg.norm(values - self.centres[np.arange(len(self.low)), cells], axis=1)
        shifts = np.arange(self.bits - 1, -1, -1)
        bits = (cells[:, :, None] >> shifts & 1).astype(np.uint8).reshape(len(values), -1)
        return [row.tobytes() for row in np.packbits(bits, axis=1)], away

    def unpack(self, packed: pa.Array) -> np.ndarray:
        dims = len(self.low)
        data = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(data, axis=1, count=dims * self.bits).reshape(-1, dims, self.bits)
        return bits @ (1 << np.arange(self.bits - 1, -1, -1))


class Intervals:
    """Lookup tables of one set of centroids.

    With m the centroids' median, |x - c|^2 - |x - m|^2 = |c - m|^2 - 2 (x - m)(c - m) is summed
    up from one entry per dimension, and lies within 2 |c - m| residuals of the sum for the cell's
    centre. ``slack`` is far above what rounding can change.
    """

    def __init__(self, cells: Cells, centroids: np.ndarray):
        # A centroid equal to an earlier one never wins a tie.
        seen = [tuple(c) for c in centroids.tolist()]
        self.live = np.array([i for i, c in enumerate(seen) if seen.index(c) == i])
        points = centroids[self.live].astype(np.float64)
        middle = np.median(points, axis=0)
        off = points - middle
        self.tables = [(o * o)[:, None] - 2 * (cells.centres - middle[:, None]) * o[:, None]
                       for o in off]
        self.slack = 1e-9 * np.array([np.abs(t).max(axis=1).sum() for t in self.tables])
        self.reach = 2.000001 * (np.linalg.norm(off, axis=1) + 1e-9 * np.linalg.norm(points, axis=1))
        self.steps = np.arange(len(middle)) * cells.centres.shape[1]

    def clusters(self, cells: np.ndarray, residual: np.ndarray) -> np.ndarray:
        """The only possible cluster of each row, or -1 where intervals overlap."""
        at = cells + self.steps
        middle = np.stack([t.ravel()[at].sum(axis=1) for t in self.tables], axis=1)
        half = residual[:, None] * self.reach + self.slack
        possible = middle - half <= (middle + half).min(axis=1)[:, None]
        one = possible.sum(axis=1) == 1
        return np.where(one, self.live[possible.argmax(axis=1)], -1)


def distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((values - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of full vectors; ties go to the smaller number."""
    return distances(values, centroids).argmin(axis=1)


class Sums:
    """Exact sums and counts of a task's vectors by cluster."""

    def __init__(self, clusters: int, dims: int):
        self.total = [[0] * (dims + 1) for _ in range(clusters)]

    def add(self, cluster: np.ndarray, values: np.ndarray, sign: int = 1) -> None:
        for c in np.unique(cluster).tolist():
            rows = values[cluster == c]
            for d, x in enumerate([*rows.sum(axis=0).tolist(), len(rows)]):
                self.total[c][d] += sign * x

    def rows(self) -> pa.RecordBatch:
        found = [(c, d, *[x >> LIMB * i & (1 << LIMB) - 1 for i in range(3)], x >> 3 * LIMB)
                 for c, row in enumerate(self.total) for d, x in enumerate(row) if x]
        columns = list(zip(*found)) if found else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          ["c", "d", "l0", "l1", "l2", "l3"])


SUM_ROWS = "c bigint, d bigint, l0 bigint, l1 bigint, l2 bigint, l3 bigint"


def _added(partial: DataFrame, totals: list[list[int]]) -> list[list[int]]:
    """Totals plus all tasks' sums."""
    limbs = [F.sum(F.col(f"l{i}").cast("decimal(20,0)")).alias(f"l{i}") for i in range(4)]
    out = [list(row) for row in totals]
    for row in partial.groupBy("c", "d").agg(*limbs).collect():
        out[row["c"]][row["d"]] += sum(int(row[f"l{i}"]) << LIMB * i for i in range(4))
    return out


def _moved(centroids: np.ndarray, totals: list[list[int]]) -> np.ndarray:
    """Means of the clusters' sums, rounded down; empty clusters keep their centroid."""
    out = centroids.copy()
    for c, (*sums, count) in enumerate(totals):
        if count:
            out[c] = np.array([x // count for x in sums], out.dtype)
    return out


class Codec:
    """What tasks need to read the table: cell bounds, and how vectors become integers."""

    def __init__(self, cells: Cells, dims: int, scale: int, wide: bool):
        self.cells, self.dims, self.scale, self.wide = cells, dims, scale, wide

    def full(self, column: pa.ListArray) -> np.ndarray:
        return exact(integers(column, self.dims, self.scale), self.wide)

    def sure(self, batch: pa.RecordBatch, table: Intervals) -> np.ndarray:
        """Clusters that the cells decide, -1 for the others."""
        return table.clusters(self.cells.unpack(batch.column("cells")),
                              batch.column("residual").to_numpy())

    def clusters(self, batch: pa.RecordBatch, table: Intervals, centroids: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, full vectors) of rows that come with both; cells decide where they can."""
        values, found = self.full(batch.column("v")), self.sure(batch, table)
        unsure = found < 0
        if unsure.any():
            found[unsure] = nearest(values[unsure], centroids)
        return found, values


class VaFile:
    """The written table (row, id, cells, residual, v) with the codec of its cells."""

    def __init__(self, vectors: DataFrame, dims: int, scale: int, bits: int, seed: int,
                 clusters: int):
        self.dims, self.scale = dims, scale
        named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
        drawn = vectors.select("v", F.sha2(named, 256).alias("h")).orderBy("h", "v").limit(
            max(SAMPLE, clusters)).collect()
        self.empty = not drawn
        if self.empty:
            return
        sample = np.floor(scale * np.array([r["v"] for r in drawn], np.float64))
        cells = Cells(sample, bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = integers(batch.column("v"), dims, scale)
                packed, away = cells.approximate(values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(packed, pa.binary()), pa.array(away),
                     pa.array(np.abs(values).max(axis=1, initial=0)), batch.column("v")],
                    ["id", "cells", "residual", "peak", "v"])

        kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "v")]
        self.table = frozen(vectors.mapInArrow(
            run, "id {}, cells binary, residual double, peak double, v {}".format(*kinds)).withColumn(
                "row", F.monotonically_increasing_id()), "va-file")
        wide = self.table.agg(F.max("peak")).first()[0] > NARROW
        self.codec = Codec(cells, dims, scale, wide)
        self.first = exact(sample[:clusters], wide)

    def all_sums(self, centroids: np.ndarray) -> list[list[int]]:
        """Sums of all vectors under their nearest centroid."""
        codec = self.codec

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, sums = Intervals(codec.cells, centroids), Sums(len(centroids), codec.dims)
            for batch in batches:
                if len(batch):
                    sums.add(*codec.clusters(batch, table, centroids))
            yield sums.rows()

        zero = [[0] * (self.dims + 1) for _ in centroids]
        return _added(self._run(["cells", "residual", "v"], run, SUM_ROWS), zero)

    def changed_sums(self, totals: list[list[int]], old: np.ndarray, new: np.ndarray) -> list[list[int]]:
        """Totals after all vectors went from their nearest old to their nearest new centroid."""
        codec = self.codec

        def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = [Intervals(codec.cells, c) for c in (old, new)]
            for batch in batches:
                if len(batch):
                    a, b = (codec.sure(batch, t) for t in tables)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").filter(pa.array((a != b) | (a < 0)))], ["row"])

        def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(len(new), codec.dims)
            for batch in batches:
                if len(batch):
                    values = codec.full(batch.column("v"))
                    a, b = nearest(values, old), nearest(values, new)
                    moved = a != b
                    sums.add(b[moved], values[moved])
                    sums.add(a[moved], values[moved], -1)
            yield sums.rows()

        fetch = frozen(self._run(["row", "cells", "residual"], unsure, "row bigint"), "fetch")
        few = fetch.count() <= BROADCAST_ROWS
        fetched = self.table.select("row", "v").join(
            F.broadcast(fetch) if few else fetch.hint("merge"), "row").select("v")
        return _added(fetched.mapInArrow(moves, SUM_ROWS), totals)

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """(id, cluster, distance) of every row."""
        codec = self.codec

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = Intervals(codec.cells, centroids)
            for batch in batches:
                if len(batch):
                    found, values = codec.clusters(batch, table, centroids)
                    away = ((values - centroids[found]) ** 2).sum(axis=1).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), pa.array(found, pa.int32()),
                         pa.array([x if x <= LONG_MAX else None for x in away], pa.int64())],
                        ["id", "cluster", "distance"])

        kind = self.table.schema["id"].dataType.simpleString()
        return self._run(["id", "cells", "residual", "v"], run, f"id {kind}, cluster int, distance bigint")

    def _run(self, columns: list[str], fn: Callable, schema: str) -> DataFrame:
        return self.table.select(*columns).mapInArrow(fn, schema)


def _long(value: Decimal | None) -> int | None:
    return int(value) if value is not None and value <= LONG_MAX else None


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS,
            scale: int = SCALE, bits: int = BITS, seed: int = SEED, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """One row per usable vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``,
    ``inertia``, ``centroid_sha256``.

    Centroids start as the vectors with the smallest hashes of their ids and move ``rounds`` times.
    """
    rows = usable(plain_columns(vectors, {"id": vec_id, "v": embedding}), dims, scale)
    file = VaFile(rows, dims, scale, bits, seed, clusters)
    out = "vec_id {}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, " \
          "centroid_sha256 string".format(rows.schema["id"].dataType.simpleString())
    if file.empty:
        return vectors.sparkSession.createDataFrame([], out)
    old, centroids, totals = None, file.first, None
    for _ in range(rounds):
        if old is not None and (old == centroids).all():
            break  # further rounds change nothing
        totals = file.all_sums(centroids) if old is None else file.changed_sums(totals, old, centroids)
        old, centroids = centroids, _moved(centroids, totals)
    found = frozen(file.assigned(centroids), "clusters")
    sums = {r["cluster"]: r["s"] if r["n"] == r["m"] else None for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"),
        F.count("distance").alias("m")).collect()}
    whole = None if None in sums.values() else sum(sums.values())
    facts = [(c, _long(s), _long(whole), hashlib.sha256(
        ",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    table = vectors.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(table), "cluster").select(
        *[part.split()[0] for part in out.split(", ")])
