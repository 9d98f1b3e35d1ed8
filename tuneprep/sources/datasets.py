"""Saved data sets: one folder each, with the data, a metadata row and a trainer registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions.text import round_even
from tuneprep.operators.formats import detect_schema_format, to_alpaca
from tuneprep.sources.files import delete_path, path_exists
from tuneprep.sources.inventory import list_files

META = "name string, format string, record_count bigint, created_at timestamp"


@dataclass(frozen=True)
class SavedDataset:
    name: str
    format: str
    record_count: int
    data: DataFrame


def _meta_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def save_dataset(records: DataFrame, base: str, name: str, fmt: str = "sharegpt",
                 file_format: str = "parquet") -> str:
    """Write the data (as instruction rows when ``fmt`` is alpaca) and its metadata.

    The stored count is that of the records given, taken while they are written.
    """
    spark = records.sparkSession
    path = f"{base.rstrip('/')}/{name}"
    seen = Observation()
    watched = records.observe(seen, F.count(F.lit(1)).alias("n"))
    out = to_alpaca(watched) if fmt == "alpaca" else watched
    out.write.mode("overwrite").format(file_format).save(f"{path}/data")
    _meta_row(spark, name=name, format=fmt, record_count=int(seen.get["n"]),
              file_format=file_format).withColumn("created_at", F.current_timestamp()) \
        .write.mode("overwrite").json(f"{path}/meta")
    return f"{path}/data"


def _file_format(spark: SparkSession, path: str) -> str:
    """File format of a folder, from the suffix of its files."""
    names = list_files(spark, path).select(F.substring_index("path", ".", -1).alias("suffix"))
    suffix = names.filter(F.col("suffix").isin("json", "parquet", "orc", "csv")).first()
    return suffix["suffix"] if suffix else "parquet"


def load_dataset(spark: SparkSession, base: str, name: str) -> SavedDataset:
    """Data and metadata; the format is detected when the metadata lacks it."""
    path = f"{base.rstrip('/')}/{name}"
    if not path_exists(spark, f"{path}/data"):
        raise FileNotFoundError(f"no data set named {name}")
    meta = {}
    if path_exists(spark, f"{path}/meta"):
        row = spark.read.schema(f"{META}, file_format string").json(f"{path}/meta").first()
        meta = row.asDict() if row else {}
    file_format = meta.get("file_format") or _file_format(spark, f"{path}/data")
    data = spark.read.format(file_format).load(f"{path}/data")
    fmt = meta.get("format") or detect_schema_format(data.schema)
    return SavedDataset(meta.get("name") or name, fmt, data.count(), data)


def list_datasets(spark: SparkSession, base: str) -> DataFrame:
    """Metadata of every saved data set with its size; unreadable metadata is skipped."""
    base = base.rstrip("/")
    owner = r"([^/]+)/(?:meta|data)/[^/]+$"
    meta = (
        spark.read.schema(META).option("mode", "DROPMALFORMED").json(f"{base}/*/meta")
        .select("*", F.regexp_extract(F.col("_metadata.file_path"), owner, 1).alias("id"))
        .filter(F.col("name").isNotNull())
    )
    sizes = (
        list_files(spark, f"{base}/*/data")
        .groupBy(F.regexp_extract("path", owner, 1).alias("id"))
        .agg(F.sum("length").alias("bytes"))
    )
    size = round_even(F.coalesce(F.col("bytes"), F.lit(0).cast("long")) / float(1024 ** 2), 2)
    return meta.join(sizes, "id", "left").select(
        "id", "name", "format", "record_count", "created_at", size.alias("size_mb")
    )


def remove_dataset(spark: SparkSession, base: str, name: str) -> None:
    path = f"{base.rstrip('/')}/{name}"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no data set named {name}")
    delete_path(spark, path)


def export_for_trainer(records: DataFrame, path: str, name: str) -> None:
    """JSON data plus the registry row that tells a trainer how to read it."""
    records.select("messages").write.mode("overwrite").json(f"{path}/data")
    tags = T.StructType([T.StructField(k, T.StringType()) for k in
                         ("role_tag", "content_tag", "user_tag", "assistant_tag")])
    entry = F.struct(
        F.lit("data").alias("file_name"),
        F.lit("sharegpt").alias("formatting"),
        F.struct(F.lit("messages").alias("messages")).alias("columns"),
        F.struct(F.lit("role"), F.lit("content"), F.lit("user"), F.lit("assistant")).cast(tags)
        .alias("tags"),
    )
    records.sparkSession.range(1).select(entry.alias(name)).write.mode("overwrite").json(
        f"{path}/dataset_info"
    )
