"""Long ids beside a null one keep all their digits in every operator that runs Python."""

import pytest
from pyspark.sql import functions as F

from tuneprep.llm import html, importance, languages, ngrams, packing, simhash, substrings, token_counts, vafile

BIG = [2**60 + 1, 2**60 + 2, 2**62 + 3, -(2**61) - 5]
TEXT = "some words of a text that is long enough to have windows of thirteen words in it, "


def documents(spark):
    rows = [(k, f"{TEXT * 2} number {i}", "en") for i, k in enumerate([*BIG, None])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)


def edits():
    return F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(1).cast("bigint").alias("start"),
                            F.lit(2).cast("bigint").alias("length"), F.lit("x").alias("text")))


def trees(docs):
    changes = docs.where("doc_id IS NOT NULL").select("doc_id", F.inline(edits()))
    return token_counts.apply_edits(docs, token_counts.build_trees(docs), changes)


OPERATORS = {
    "op1": lambda docs: ngrams.score(docs, docs.select("doc_id", F.lit(1).alias("quality")).limit(2)),
    "op3": simhash.near_duplicates,
    "op4": packing.pack,
    "op8": lambda docs: token_counts.count_edited(docs.withColumn("edits", edits())),
    "op8 trees": trees,
    "op9": substrings.without_repeats,
    "op11": languages.language_report,
    "op12": lambda docs: importance.resample(docs, docs.select("text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    found = [r["doc_id"] for r in OPERATORS[name](documents(spark)).select("doc_id").collect()]
    assert sorted(found, key=repr) == sorted([*BIG, None], key=repr)


def test_components(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert {r["component_id"] for r in rows} <= set(BIG)


def test_pages_and_vectors(spark):
    pages = documents(spark).select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r["page_id"] for r in html.extract(pages).collect()} == {*BIG, None}
    vectors = documents(spark).select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("double")).alias("embedding"))
    assert {r["vec_id"] for r in vafile.cluster(vectors, dims=1, clusters=2, rounds=1).collect()} == {*BIG, None}
