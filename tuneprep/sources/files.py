"""File readers and the import dispatch."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions.text import once, strip
from tuneprep.operators.formats import detect_schema_format, to_messages
from tuneprep.sources.records import CsvRows, JsonArray, split_records

WRAPPER_KEYS = ["data", "items", "examples", "records", "rows"]
CORRUPT = "_corrupt_record"


class ImportFailed(ValueError):
    """The file is missing, of an unknown type, or holds no records."""


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    return fs.exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    return fs.delete(target, True)


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the folders ``<path>/<name>=<n>``."""
    target, fs = _hadoop_path(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(f.removeprefix(f"{name}=")) for f in found if f.startswith(f"{name}="))


def _unwrap(df: DataFrame) -> DataFrame:
    """Open ``{"data": [...]}`` style documents; other rows stay as they are."""
    for key in WRAPPER_KEYS:
        if key in df.columns:
            kind = df.schema[key].dataType
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                return df.select(F.inline(key))
    return df


def _strings(df: DataFrame):
    """A one-column table as the JVM's data set of strings, which its readers parse."""
    return getattr(df._jdf, "as")(df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())


def _json_lines(spark: SparkSession, paths: list[str], schema: T.StructType | None) -> DataFrame:
    if schema is None:
        schema = spark.read.option("mode", "DROPMALFORMED").json(paths).schema
    return _parsed_json(spark.read.text(paths), schema)


def _json_array(spark: SparkSession, paths: list[str], schema: T.StructType | None) -> DataFrame:
    """Objects of array files, each file read by many tasks."""
    records = split_records(spark, paths, JsonArray()).select("value")
    if schema is None:
        reader = spark.read.option("mode", "DROPMALFORMED")
        schema = DataFrame(reader._jreader.json(_strings(records)), spark).schema
    return _parsed_json(records, schema)


def _parsed_json(texts: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON texts in a ``value`` column; bad ones are skipped."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return (
        texts.filter(strip(F.col("value")) != "")
        .select(F.from_json("value", full, options).alias("r"))
        .filter(F.col(f"r.{CORRUPT}").isNull())
        .select("r.*")
        .drop(CORRUPT)
    )


def _json_shapes(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Paths of the files that hold an array, JSON lines, or one document.

    An array starts with its bracket. A file holds lines when some line of it is a JSON object on
    its own. Files without text are left out. There is one row per file, as in the listing that
    the driver has anyway; fragments are short, whatever the lines are.
    """
    file, text = F.col("_metadata.file_path").alias("file"), strip(F.col("value"))
    shapes: dict[str, list[str]] = {"array": [], "lines": [], "document": []}
    heads = spark.read.option("lineSep", JsonArray.separator).text(path).filter(text != "").select(
        file, F.substring(text, 1, 1).alias("start"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    others = []
    for row in heads.groupBy("file").agg(
            F.min_by("start", F.struct("block", "row")).alias("start")).collect():
        (shapes["array"] if row["start"] == "[" else others).append(unquote(row["file"]))
    if others:
        lone = F.startswith(text, F.lit("{")) & F.try_parse_json(text).isNotNull()
        for row in spark.read.text(others).filter(text != "").groupBy(file).agg(
                F.max(lone).alias("lines")).collect():
            shapes["lines" if row["lines"] else "document"].append(unquote(row["file"]))
    return shapes


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines (bad lines skipped), JSON arrays, or documents with a wrapper key.

    Each file is read by its own shape. Lines and arrays are read in parallel, whether an array is
    pretty-printed or one line; a document is one unsplittable text. A document on one line with
    nothing but the wrapper key is opened as well.
    """
    shapes = _json_shapes(spark, path)
    found = []
    if shapes["lines"]:
        lines = _json_lines(spark, shapes["lines"], schema)
        only = lines.columns
        found.append(_unwrap(lines) if len(only) == 1 and only[0] in WRAPPER_KEYS else lines)
    if shapes["array"]:
        found.append(_json_array(spark, shapes["array"], schema))
    if shapes["document"]:
        whole = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED")
        whole = (whole.schema(schema) if schema is not None else whole).json(shapes["document"])
        found.append(whole if schema is not None else _unwrap(whole))
    found = [df for df in found if df.columns]
    if not found:
        raise ImportFailed("no records in the file")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file at a path."""
    target, fs = _hadoop_path(spark, path)
    sizes, todo = [0], [s for s in fs.globStatus(target) or []]
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += list(fs.listStatus(status.getPath()))
        else:
            sizes.append(status.getLen())
    return max(sizes)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             split: bool | None = None) -> DataFrame:
    """CSV with a header; quoted fields may span lines.

    ``split`` reads each file by many tasks. By default that is done when a file is larger than
    one task's share of bytes; the rows are the same either way.
    """
    options = {"header": "true", "escape": '"', "multiLine": "true"}
    if split is None:
        share = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
        unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(share[-1:], 1)
        split = _largest_file(spark, path) > int(share.rstrip("kmg")) * unit
    if not split:
        reader = spark.read.options(**options)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
        return reader.csv(path)
    records = split_records(spark, [path], CsvRows()).where("NOT first").select(
        F.rtrim("value", F.lit("\r")).alias("value"))
    reader = spark.read.options(**options | {"header": "false"})
    if schema is not None:
        return DataFrame(reader.schema(schema)._jreader.csv(_strings(records)), spark)
    names = spark.read.options(**options).csv(path).columns
    found = DataFrame(reader.option("inferSchema", "true")._jreader.csv(_strings(records)), spark)
    return found.toDF(*names) if found.columns else spark.createDataFrame(
        [], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_qa_line(text: Column) -> Column:
    """Struct(question, answer, instruction, output) of a stripped line; null if it is empty."""
    parts = F.split(text, "\t")
    pair = F.size(parts) >= 2
    return F.when(text != "", F.struct(
        F.when(pair, F.get(parts, 0)).alias("question"),
        F.when(pair, F.get(parts, 1)).alias("answer"),
        F.when(~pair, F.get(parts, 0)).alias("instruction"),
        F.when(~pair, F.lit("")).alias("output"),
    ))


def read_tsv_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question/answer lines; a line without tab is an instruction with an empty output."""
    return parse_qa_lines(spark.read.text(path), "value")


def parse_qa_lines(lines: DataFrame, column: str) -> DataFrame:
    kept = [c for c in lines.columns if c != column]
    return (
        lines.select(*kept, once(strip(F.col(column)), parse_qa_line).alias("_qa"))
        .filter(F.col("_qa").isNotNull())
        .select(*kept, "_qa.*")
    )


READERS = {
    ".json": read_json, ".jsonl": read_json, ".csv": read_csv, ".parquet": read_parquet,
    ".txt": read_tsv_qa,
}


@dataclass(frozen=True)
class Imported:
    format: str
    raw: DataFrame
    records: DataFrame


def import_dataset(spark: SparkSession, path: str, compat: bool = False,
                   suffix: str | None = None) -> Imported:
    """Read by file suffix, detect the format and convert to (ord, messages).

    ``ord`` is taken from the data when present, otherwise it numbers the rows as read.
    """
    if not path_exists(spark, path):
        raise ImportFailed("file does not exist")
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = (suffix or ("." + name.rsplit(".", 1)[-1] if "." in name else "")).lower()
    if kind not in READERS:
        raise ImportFailed(f"unsupported file type: {kind}")
    raw = READERS[kind](spark, path)
    if raw.isEmpty():
        raise ImportFailed("no records in the file")
    fmt = detect_schema_format(raw.schema)
    if "ord" not in raw.columns:
        raw = raw.withColumn("ord", F.monotonically_increasing_id())
    return Imported(fmt, raw, to_messages(raw, fmt=fmt, compat=compat))
