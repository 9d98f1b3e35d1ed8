"""A stored experiment history whose operations rewrite only what they change.

The three tables are Parquet partitioned by a bucket of the experiment's id (a hash modulo
``buckets``). An operation finds the buckets of its ids (at most ``buckets`` numbers) and reads those
folders only. Updates and deletes replace them by dynamic partition overwrite, inserts add files;
all other files stay as they are.
Bytes read and written therefore follow the number of ids, not the size of the history. A bucket
with many rows, as one busy experiment makes it, is split between tasks when it is written.

Every operation may be repeated, after a failure for instance: inserts then reject what is there
already, updates and deletes change nothing more. One operation at a time may run on a store. Null
ids are a bucket like any other for reading; no operation names them.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.operators.experiments import (
    accepted_experiments, delete_experiments, update_experiments,
)
from tuneprep.session import scratch_path
from tuneprep.sources.files import delete_path

BUCKET = "bucket"
OWNERS = {"experiments": "id", "checkpoints": "experiment_id", "metrics": "experiment_id"}


@dataclass(frozen=True)
class ExperimentStore:
    """Tables ``experiments``, ``checkpoints`` and ``metrics`` below ``path``."""

    spark: SparkSession
    path: str
    buckets: int = 1024

    def _bucket(self, owner: str) -> Column:
        return F.pmod(F.xxhash64(owner), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        rows = rows.withColumn(BUCKET, self._bucket(OWNERS[name])).hint("rebalance", BUCKET)
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
            BUCKET).parquet(f"{self.path}/{name}")

    def create(self, **tables: DataFrame) -> None:
        """Write the first version of the three tables."""
        schemas = [(name, tables[name].schema.json()) for name in OWNERS]
        for name in OWNERS:
            self._write(name, tables[name], "error")
        self.spark.createDataFrame(schemas, "name string, fields string").coalesce(1).write.parquet(
            f"{self.path}/schemas")

    @functools.cached_property
    def schemas(self) -> dict[str, T.StructType]:
        """Schemas as created, so that a table without rows can be read."""
        return {r["name"]: T.StructType.fromJson(json.loads(r["fields"])).add(BUCKET, T.IntegerType())
                for r in self.spark.read.parquet(f"{self.path}/schemas").collect()}

    def table(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """A whole table, or its rows in some buckets (the other folders are not listed as input)."""
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        if touched is not None:
            rows = rows.where(F.col(BUCKET).isin(touched))
        return rows.drop(BUCKET)

    def touched(self, ids: DataFrame, owner: str = "id") -> list[int]:
        """Buckets of the ids."""
        numbers = ids.where(F.col(owner).isNotNull()).select(self._bucket(owner).alias(BUCKET)).distinct()
        return sorted(r[0] for r in numbers.collect())

    def _shrink(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """Make ``rows`` the content of the buckets; those left without rows go.

        The rows are computed once: a bucket that still has a file from before got no rows.
        """
        before = set(self.table(name).inputFiles())
        self._write(name, rows, "overwrite")
        kept = before.intersection(self.table(name).inputFiles())
        still = {int(n) for file in kept for n in re.findall(rf"/{BUCKET}=(\d+)/", file)}
        for bucket in still.intersection(touched):
            delete_path(self.spark, f"{self.path}/{name}/{BUCKET}={bucket}")

    def insert(self, new: DataFrame) -> DataFrame:
        """Add experiments (see ``accepted_experiments``); returns the rejected rows."""
        touched = self.touched(new)

        def written(rows: DataFrame) -> DataFrame:  # before the table that it is judged by changes
            path = scratch_path(self.spark, "judged")
            rows.write.parquet(path)
            return self.spark.read.schema(rows.schema).parquet(path)

        base = self.table("experiments", touched)
        accepted, rejected = accepted_experiments(base, new, written)
        if touched:  # what is there stays as it is
            self._write("experiments", base.where("false").unionByName(
                accepted, allowMissingColumns=True), "append")
        return rejected

    def update(self, updates: DataFrame) -> None:
        """Change experiments (see ``update_experiments``)."""
        touched = self.touched(updates)
        if touched:
            self._write("experiments", update_experiments(
                self.table("experiments", touched), updates), "overwrite")

    def delete(self, ids: DataFrame) -> None:
        """Remove experiments with their checkpoints and metrics, the experiments last.

        A repeated call finds what an interrupted one has left by the ids it is given again.
        """
        touched = self.touched(ids)
        if touched:
            kept = delete_experiments(ids, *[self.table(name, touched) for name in OWNERS])
            for name, rows in reversed(list(zip(OWNERS, kept))):
                self._shrink(name, rows, touched)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add checkpoint or metric rows."""
        self._write(name, rows, "append")
