"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.text import let
from tuneprep.session import scratch_path

SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

__all__ = ["SPACE_CLASS", "SPACES", "frozen", "let", "map_with_ids", "read_table", "row_hash", "space_words",
           "with_default"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frozen(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared scratch folder and read it back.

    Later stages restart from the files when an executor is lost, and every use of the table
    sees the same rows, even where the plan above is not deterministic.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_default(col: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(col, F.lit(""))


def row_hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def space_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for empty and null texts."""
    trimmed = F.btrim(with_default(text), F.lit(SPACES))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>"))
               .otherwise(F.split(t, SPACE_CLASS)))


def map_with_ids(df: DataFrame, run: Callable, key: str, schema: str) -> DataFrame:
    """``mapInPandas`` that passes an id column as text, and gives it its own type again.

    Pandas makes doubles of whole numbers where one is null, and long ids then lose digits.
    ``schema`` has ``{}`` in the id's place.
    """
    kind = df.schema[key].dataType
    return df.withColumn(key, F.col(key).cast("string")).mapInPandas(
        run, schema.format("string")).withColumn(key, F.col(key).cast(kind))


def plain_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named columns (new name -> column), so other columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(new) for new, source in names.items()])


