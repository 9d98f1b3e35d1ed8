"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Engine settings the operators are written for. AQE coalesces small shuffle
# partitions, splits skewed ones and turns a sort-merge join into a hash join
# when the build side of every partition is small at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Scratch folders of one process share this name.
RUN = uuid.uuid4().hex


def build_session(app: str = "tuneprep", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session; leave the shuffle partition count to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder under ``spark.checkpoint.dir`` (the cluster's shared folder).

    Where the setting is absent, a local session takes a temporary folder that is removed at the
    end of the process; on a cluster, whose executors would not see it, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/tuneprep-{RUN}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tuneprep-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this process wrote below ``spark.checkpoint.dir``; results read from it end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tuneprep-{RUN}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Freeze a table in the reliable checkpoint folder, so lost executors cannot change it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(df.sparkSession, "checkpoint"))
    return df.checkpoint()
