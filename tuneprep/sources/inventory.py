"""File inventories: models on disk and checkpoints.

All functions take a (path, length, modificationTime) listing, so a catalogue table works as
well as a directory walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.catalog import licence_class
from tuneprep.functions.text import base_name, matches_glob

# --- Fixed values: top-level files that mark a downloaded model ---
MODEL_FILES = ["*.safetensors", "*.gguf", "config.json"]
CONFIG = ("architectures array<string>, model_type string, hidden_size bigint, "
          "num_hidden_layers bigint, vocab_size bigint, license string")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Recursive listing; file contents are never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )


def library_inventory(files: DataFrame, root: str) -> DataFrame:
    """Per model folder below ``root``: size, file count, and whether it counts as downloaded.

    Names starting with a dot are left out.
    """
    inner, name = F.col("_inner"), F.col("_name")
    return (
        files.select("length", F.substring_index("path", f"{root.rstrip('/')}/", -1).alias("_inner"))
        .select(
            "length", F.substring_index(inner, "/", 1).alias("model_dir"),
            base_name(inner).alias("_name"),
            (F.substring_index(inner, "/", 2) == inner).alias("_top"),
        )
        .filter(~F.startswith(name, F.lit(".")))
        .withColumn("_model", F.col("_top") & matches_glob(name, MODEL_FILES))
        .groupBy("model_dir")
        .agg(
            (F.sum("length") / float(1024 ** 3)).alias("size_gb"),
            F.count(F.lit(1)).alias("file_count"),
            F.bool_or("_model").alias("is_downloaded"),
        )
        .withColumn("model_id", F.replace("model_dir", F.lit("--"), F.lit("/")))
    )


def with_model_config(inventory: DataFrame, configs: DataFrame) -> DataFrame:
    """Add fields of each model's config text (model_dir, config) and its licence class."""
    parsed = configs.select("model_dir", F.from_json("config", CONFIG).alias("c"))
    joined = inventory.join(parsed, "model_dir", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        *inventory.columns,
        F.coalesce("c.architectures", F.array().cast("array<string>")).alias("architecture"),
        F.coalesce("c.model_type", F.lit("")).alias("model_type"),
        F.coalesce("c.hidden_size", zero).alias("hidden_size"),
        F.coalesce("c.num_hidden_layers", zero).alias("num_layers"),
        F.coalesce("c.vocab_size", zero).alias("vocab_size"),
        licence_class(F.col("c.license")).alias("license_class"),
    )


def library_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("model_count"),
        F.coalesce(F.sum("size_gb"), F.lit(0.0)).alias("total_size_gb"),
    )


def checkpoint_inventory(files: DataFrame) -> DataFrame:
    """Per ``checkpoint-<step>`` folder: step, size and newest change; latest step first."""
    folder = F.regexp_extract("path", r"^(.*/checkpoint-\d+)/", 1)
    return (
        files.withColumn("path", folder)
        .filter(F.col("path") != "")
        .groupBy("path")
        .agg(
            (F.sum("length") / float(1024 ** 2)).alias("size_mb"),
            F.max("modificationTime").alias("modified"),
        )
        .withColumn("step", F.regexp_extract("path", r"checkpoint-(\d+)$", 1).cast("long"))
        .orderBy(F.col("step").desc(), "path")
    )
