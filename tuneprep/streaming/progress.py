"""Live training progress from growing sets of log files."""

from __future__ import annotations

import functools
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tuneprep.operators.monitor import RECENT, parse_log, progress
from tuneprep.sources.files import delete_path, numbered_folders, path_exists
from tuneprep.sources.growing import RANGE_BYTES, growing_lines

POINT = ["ord", "step", "epoch", "loss", "elapsed_seconds"]
SNAPSHOT = [
    "experiment_id", "current_step", "current_epoch", "current_loss", "best_loss",
    "elapsed_seconds", "steps_per_second", "points",
]

# Keyed state needs this store. Without the second setting a query whose state expires would run
# empty batches for ever, and "availableNow" would never end; expired state goes with later data.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
EXPIRE_SECONDS = 7 * 86_400
COMPACT = 50            # batches between compactions of the snapshot table
HELD = 10_000           # partial snapshots a task holds


def log_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(experiment_id, ord, line) of the logs ``<path>/<experiment_id>/*``, as they grow.

    A log may grow in place, by further files, or both; appended bytes are read once and half
    written lines when they are complete. ``ord`` is (written, file, position). Folders named
    ``<key>=<experiment_id>`` work too.
    """
    return growing_lines(spark, path, range_bytes).select(
        F.col("folder").alias("experiment_id"), F.struct("written", "file", "position").alias("ord"),
        "line")


def _place(point: dict) -> tuple:
    """Sort key of a point: its ``ord``, a number or a struct."""
    return tuple(point["ord"].values()) if isinstance(point["ord"], dict) else (point["ord"],)


def _lower(a: float | None, b: float | None) -> float | None:
    """The smaller loss as SQL's minimum takes it: without nulls, NaN last."""
    found = [x for x in (a, b) if x is not None]
    return min(found, key=lambda x: (x != x, x)) if found else None


def merged(held: dict | None, more: dict) -> dict:
    """Two partial snapshots as one: the newest points, their number, the best loss."""
    if held is None:
        return more
    newest = sorted([*held["newest"], *more["newest"]], key=_place, reverse=True)[:RECENT]
    return {"start": held["start"], "points": held["points"] + more["points"],
            "best_loss": _lower(held["best_loss"], more["best_loss"]), "newest": newest}


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial snapshot per experiment and task, in a bounded buffer."""
    held: dict[str, dict] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(map(json.dumps, held.values()), pa.string())],
            ["experiment_id", "partial"])

    for batch in batches:
        rows: dict[str, list[dict]] = defaultdict(list)
        for row in batch.to_pylist():
            rows[row.pop("experiment_id")].append(row)
        for key, points in rows.items():
            best = functools.reduce(_lower, [p["loss"] for p in points])
            newest = heapq.nlargest(RECENT, points, key=_place)
            held[key] = merged(held.get(key), {
                "start": min(points, key=_place)["ord"], "points": len(points), "best_loss": best,
                "newest": newest})
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


class SnapshotState(StatefulProcessor):
    """Keeps one snapshot per experiment; only experiments with new points are touched.

    The state of an experiment without new points expires. Its last row stays in the table, and if
    its log goes on, a row of its own (another ``start``) adds to it when the table is read.
    """

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle) -> None:
        self.value = handle.getValueState("snapshot", "snapshot string", self.expire_ms)

    def handleInputRows(self, key, rows, timerValues):
        held = json.loads(self.value.get()[0]) if self.value.exists() else None
        for row in rows:
            held = merged(held, json.loads(row["partial"]))
        self.value.update((json.dumps(held),))
        yield Row(experiment_id=key[0], start=json.dumps(held["start"]), snapshot=json.dumps(held))


def write_snapshots(lines: DataFrame, path: str, checkpoint: str, expire_seconds: int = EXPIRE_SECONDS,
                    **trigger):
    """Start the update stream of (experiment_id, ord, line): the snapshots of all experiments.

    A task reduces its lines to one partial snapshot per experiment; the state store merges them
    by experiment. A batch writes one row per experiment that has new points, so its cost follows
    the batch, not the number of experiments; every ``COMPACT`` batches the rows are compacted to
    the last one of each experiment. A repeated batch writes the same version again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/updates/version={batch_id}")
        if batch_id % COMPACT == COMPACT - 1:
            _compact(batch.sparkSession, path, batch_id)

    points = parse_log(lines).select("experiment_id", *POINT).where(
        "experiment_id IS NOT NULL AND ord IS NOT NULL")
    snapshots = points.mapInArrow(_partials, "experiment_id string, partial string").groupBy(
        "experiment_id").transformWithState(
            SnapshotState(expire_seconds * 1000), "experiment_id string, start string, snapshot string",
            "Update", "ProcessingTime")
    conf = lines.sparkSession.conf
    before = {key: conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        conf.set(key, value)
    try:  # the query keeps the settings it starts with
        return (snapshots.writeStream.option("checkpointLocation", checkpoint).outputMode("update")
                .trigger(**(trigger or {"processingTime": "10 seconds"})).foreachBatch(write).start())
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def _newest_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The last row of every experiment and state: the newest complete base and later versions."""
    base = max((n for n in numbered_folders(spark, path, "base")
                if path_exists(spark, f"{path}/base={n}/_SUCCESS")), default=-1)
    parts = [spark.read.parquet(f"{path}/base={base}")] if base >= 0 else []
    late = [n for n in numbered_folders(spark, f"{path}/updates", "version") if n > base
            and path_exists(spark, f"{path}/updates/version={n}/_SUCCESS")]
    if late:
        found = spark.read.option("basePath", f"{path}/updates").parquet(
            *[f"{path}/updates/version={n}" for n in late])
        parts.append(found.withColumn("version", F.col("version").cast("long")))
    if not parts:
        return None
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.groupBy("experiment_id", "start").agg(
        F.max_by("snapshot", "version").alias("snapshot"), F.max("version").alias("version"))


def _compact(spark: SparkSession, path: str, version: int) -> None:
    """Write the last rows as a base and drop what it replaces."""
    rows = _newest_rows(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/base={version}")
    for n in numbered_folders(spark, path, "base"):
        if n < version:
            delete_path(spark, f"{path}/base={n}")
    for n in numbered_folders(spark, f"{path}/updates", "version"):
        if n <= version:
            delete_path(spark, f"{path}/updates/version={n}")


def write_metrics(lines: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the append stream of parsed metric rows into a Parquet table."""
    return (
        parse_log(lines).writeStream.outputMode("append")
        .format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def latest_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot per experiment from the table that ``write_snapshots`` keeps.

    Points are ordered by the version of their row and their place in it.
    """
    point = "array<struct<step: bigint, epoch: double, loss: double, elapsed_seconds: double>>"
    schema = f"points bigint, best_loss double, newest {point}"
    rows = _newest_rows(spark, path)
    if rows is None:
        rows = spark.createDataFrame([], "experiment_id string, snapshot string, version bigint")
    rows = rows.select("experiment_id", "version", F.from_json("snapshot", schema).alias("s"))
    totals = rows.groupBy("experiment_id").agg(
        F.sum("s.points").alias("points"), F.min("s.best_loss").alias("best_loss"))
    points = rows.select("experiment_id", "version", F.posexplode("s.newest").alias("at", "p")).select(
        "experiment_id", (F.col("version") * RECENT + RECENT - 1 - F.col("at")).alias("ord"), "p.*")
    return progress(points).drop("best_loss", "points").join(totals, "experiment_id").select(SNAPSHOT)
