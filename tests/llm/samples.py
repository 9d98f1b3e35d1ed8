"""Inputs of the operator tests: a sample of the driver's table, and awkward rows."""

import duckdb
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 20_000
ROWS = [
    (1, "One short line, nothing else."), (1, "One short line, nothing else."), (2, None), (3, ""),
    (None, "A text without an id, long enough to have a few shingles of three words."),
    (None, None), (4, " \n\t "), (5, LONG), (6, LONG), (7, "x" * 50_000), (8, "Ünïcödé 中文 😀 words"),
]
EXTRA = ["id", "row", "fp", "words", "lines", "host", "kept", "spots", "file", "length", "rank",
         "edits", "piece", "term", "kind", "base", "fold", "key", "gram", "place", "score", "bucket",
         "d", "r", "v", "cells", "n_words", "weight", "cluster"]


def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM read_parquet('{DATA}/documents.parquet')"
                      ).fetchall()


def table(spark, rows, with_extra=True):
    df = spark.createDataFrame([(k, t, "h") for k, t in rows],
                               "doc_id bigint, text string, source string")
    return df.select("*", *[F.lit(-1).alias(c) for c in EXTRA]) if with_extra else df


def by_row(rows, names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)
