"""Training-corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, read_table
from tuneprep.llm.decontam import clean_documents
from tuneprep.llm.packing import pack
from tuneprep.llm.pii import redact
from tuneprep.llm.quality import apply_rules
from tuneprep.llm.simhash import representatives

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; ``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents and take lines above their host's limit out of the others."""
    return _documents(apply_rules(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked fingerprints: the smallest id, null ids last.

    Rows that share an id but are no near copies of one another all stay.
    """
    return _documents(representatives(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of a benchmark item."""
    return _documents(clean_documents(docs, read_table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text."""
    return _documents(redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: Fingerprints, boosted trees and packing are not SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = frozen(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
