"""Queries through files: readers, saved data sets, inventories.

The input tables are first written as files into the shared scratch folder, then read back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.operators.catalog import filter_files
from tuneprep.operators.formats import turns_to_alpaca
from tuneprep.plans.registry import query
from tuneprep.plans.tables import Tables
from tuneprep.schema import MESSAGES
from tuneprep.session import scratch_path
from tuneprep.sources import datasets as D
from tuneprep.sources import files as S
from tuneprep.sources import inventory as I


@query("SELECT ord, text, lang, source FROM v_docs")
def read_json(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lines.jsonl")
    t.documents().write.json(path)
    broken = t.spark.range(1).select(F.lit('{"ord": 1, "text": ').alias("value"))
    broken.write.mode("append").text(path)
    return S.read_json(t.spark, path).select("ord", "text", "lang", "source")


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a task as the lines of one JSON array."""
    before = "["
    for batch in batches:
        for value in batch.column("value").to_pylist():
            yield pa.RecordBatch.from_pydict({"value": [before + value]})
            before = ", "
    yield pa.RecordBatch.from_pydict({"value": ["]" if before == ", " else "[]"]})


@query("SELECT ord, text, lang, source FROM v_docs")
def read_json_array(t: Tables) -> DataFrame:
    """Documents as pretty-printed array files, each read by many tasks."""
    path = scratch_path(t.spark, "arrays.json")
    texts = t.documents().select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
    texts.mapInArrow(_as_arrays, "value string").write.text(path)
    return S.read_json(t.spark, path, "ord bigint, text string, lang string, source string")


def _csv_pairs(t: Tables) -> str:
    path = scratch_path(t.spark, "rows.csv")
    t.pairs().select("ord", "instruction", "output").write \
        .option("header", "true").option("escape", '"').option("quoteAll", "true") \
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false") \
        .csv(path)
    return path


@query("SELECT ord, instruction, output FROM v_pairs")
def read_csv(t: Tables) -> DataFrame:
    return S.read_csv(t.spark, _csv_pairs(t), schema="ord bigint, instruction string, output string")


@query("SELECT ord, instruction, output FROM v_pairs")
def read_csv_split(t: Tables) -> DataFrame:
    """The same files, cut at any line."""
    return S.read_csv(t.spark, _csv_pairs(t), "ord bigint, instruction string, output string", True)


@query("""
SELECT ord, 'alpaca' AS format,
       'user:' || instruction || chr(10) || 'assistant:' || output AS chat FROM v_pairs""")
def import_dataset(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "pairs") + ".parquet"
    t.pairs().write.parquet(path)
    loaded = S.import_dataset(t.spark, path)
    line = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return loaded.records.select("ord", F.lit(loaded.format).alias("format"),
                                 F.array_join(line, "\n").alias("chat"))


@query("""
SELECT ord, instruction, output, 'alpaca' AS format, count(*) OVER () AS record_count FROM (
    SELECT ord, arg_max(content, turn) FILTER (role = 'user') AS instruction,
           arg_max(content, turn) FILTER (role = 'assistant') AS output
    FROM v_turns GROUP BY ord)
WHERE instruction IS NOT NULL AND output IS NOT NULL""")
def save_load(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "datasets")
    D.save_dataset(turns_to_alpaca(t.turns()), base, "chats", "alpaca")
    loaded = D.load_dataset(t.spark, base, "chats")
    return loaded.data.select("ord", "instruction", "output", F.lit(loaded.format).alias("format"),
                              F.lit(loaded.record_count).cast("long").alias("record_count"))


@query("""
SELECT 'chats' AS id, 'chats' AS name, 'sharegpt' AS format, count(DISTINCT ord) AS record_count,
       true AS has_size FROM v_turns
UNION ALL SELECT 'docs', 'docs', 'sharegpt', count(*), true FROM v_docs""")
def list_datasets(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "datasets")
    D.save_dataset(t.chats().select("ord", "messages"), base, "chats")
    D.save_dataset(t.doc_records(), base, "docs")
    return D.list_datasets(t.spark, base).select(
        "id", "name", "format", "record_count", (F.col("size_mb") > 0).alias("has_size")
    )


@query("SELECT 'docs' AS id, count(*) AS record_count FROM v_docs")
def remove_dataset(t: Tables) -> DataFrame:
    """What is listed after one of two data sets was removed."""
    base = scratch_path(t.spark, "datasets")
    D.save_dataset(t.chats().select("ord", "messages"), base, "chats")
    D.save_dataset(t.doc_records(), base, "docs")
    D.remove_dataset(t.spark, base, "chats")
    return D.list_datasets(t.spark, base).select("id", "record_count")


@query("""
SELECT string_agg(role || ':' || content, chr(10) ORDER BY turn) AS chat, 'data' AS file_name,
       'sharegpt' AS formatting, 'messages' AS messages_column, 'user' AS user_tag
FROM v_turns GROUP BY ord""")
def trainer_export(t: Tables) -> DataFrame:
    """The exported files, read as their registry row tells."""
    path = scratch_path(t.spark, "export")
    D.export_for_trainer(t.chats(), path, "mine")
    entry = t.spark.read.json(f"{path}/dataset_info").first()["mine"]
    data = t.spark.read.schema(T.StructType([T.StructField(entry.columns.messages, MESSAGES)])).json(
        f"{path}/{entry.file_name}")
    line = F.transform(entry.columns.messages, lambda m: F.concat_ws(
        ":", m[entry.tags.role_tag], m[entry.tags.content_tag]))
    return data.select(
        F.array_join(line, "\n").alias("chat"), F.lit(entry.file_name).alias("file_name"),
        F.lit(entry.formatting).alias("formatting"),
        F.lit(entry.columns.messages).alias("messages_column"), F.lit(entry.tags.user_tag).alias("user_tag"))


_INVENTORY = """
split AS (SELECT string_split(substr(path, 9), '/') AS p, length FROM v_files),
inv AS (SELECT p[1] AS model_dir, sum(length) / 1073741824 AS size_gb, count(*) AS file_count,
               bool_or(len(p) = 2 AND (p[2] = 'config.json' OR suffix(p[2], '.safetensors')
                                       OR suffix(p[2], '.gguf'))) AS is_downloaded
        FROM split WHERE NOT starts_with(p[-1], '.') GROUP BY p[1])"""


@query(f"""
WITH {_INVENTORY}, configs AS (
    SELECT replace(regexp_replace(model_id, '$', ''), '/', '--') AS model_dir,
           ord, p_type, p_size FROM v_models)
SELECT inv.model_dir, replace(inv.model_dir, '--', '/') AS model_id, size_gb, file_count,
       is_downloaded, CASE WHEN c.ord % 5 <> 4 THEN lower(p_type) ELSE '' END AS model_type,
       CASE WHEN c.ord % 5 <> 4 THEN p_size * 64 ELSE 0 END AS hidden_size,
       CASE WHEN c.ord % 5 <> 4 THEN 'commercial' ELSE 'unknown' END AS license_class
FROM inv LEFT JOIN configs c USING (model_dir)""")
def library_inventory(t: Tables) -> DataFrame:
    inventory = I.library_inventory(t.files(), "/models")
    full = I.with_model_config(inventory, t.model_configs())
    return full.select("model_dir", "model_id", "size_gb", "file_count", "is_downloaded",
                       "model_type", "hidden_size", "license_class")


@query(f"""WITH {_INVENTORY}
SELECT count(*) AS model_count, round(sum(size_gb), 6) AS total_size_gb FROM inv""")
def library_totals(t: Tables) -> DataFrame:
    totals = I.library_totals(I.library_inventory(t.files(), "/models"))
    return totals.withColumn("total_size_gb", F.round("total_size_gb", 6))


@query("""
SELECT regexp_extract(path, '^(.*/checkpoint-[0-9]+)/', 1) AS path,
       CAST(regexp_extract(path, 'checkpoint-([0-9]+)/', 1) AS BIGINT) AS step,
       sum(length) / 1048576 AS size_mb, max(modified) AS modified
FROM v_checkpoint_files GROUP BY 1, 2""")
def checkpoint_inventory(t: Tables) -> DataFrame:
    return I.checkpoint_inventory(t.checkpoint_files()).select("path", "step", "size_mb", "modified")


@query("""
SELECT path, length FROM v_files
WHERE NOT suffix(path, '.bin') AND (suffix(path, '.json') OR suffix(path, '.safetensors'))""")
def file_filter(t: Tables) -> DataFrame:
    return filter_files(t.files(), allow=["*.json", "*.safetensors"])
