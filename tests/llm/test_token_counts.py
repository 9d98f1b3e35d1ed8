"""Edited token counts against encoding the whole text again."""

import random

import samples
from pyspark.sql import functions as F

from tuneprep.llm.token_counts import EditedText, apply_edits, build_trees, count_edited, counter
from tuneprep.llm.tokens import encoder

PARTS = ["the", " ", "  ", "\n", " the", "'re", "'r", "e", "s", "'", "foo", "12", ".", "\t", ", ", "é",
         "<|endoftext|>", " \n", "ing", "的", "中文", "。", "，", "！？", "カ", "・", "한", "1,5", "a.b"]


def full(text):
    return len(encoder().tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_random_edits():
    rng, count = random.Random(6), counter(None)
    for _ in range(1200):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 120)))
        state = EditedText(text, count, leaf_chars=rng.choice([4, 10, 30]))
        for _ in range(6):
            at, length = rng.randint(0, len(text) + 2), rng.randint(0, 12)
            new = "".join(rng.choices(PARTS, k=rng.randint(0, 6)))
            state.edit(at, length, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + length:]
            assert state.text == text and state.tree.total == (len(text), full(text))


def test_small_edit_encodes_little():
    text = "some words of a long text " * 4000
    state = EditedText(text, counter(None))
    before = state.encoded
    state.edit(50_000, 5, "other")
    assert state.encoded - before < 2000


def test_text_without_spaces():
    text = "这是一个很长的句子，没有空格。" * 70_000
    state = EditedText(text, counter(None))
    before = state.encoded
    state.edit(500_000, 3, "，新的。")
    assert before == len(text) and state.encoded - before < 2000


def edited(text, edits):
    for start, length, new in edits:
        start = min(start, len(text))
        text = text[:start] + new + text[start + length:]
    return text


def test_tables(spark):
    rows = [(k, t) for k, t, _ in samples.documents()[:60]] + [(k and k + 10**6, t) for k, t in samples.ROWS]
    docs = samples.table(spark, rows)
    changes = [(k, n, 10 * n, n, f" new{n}'s") for k, _ in rows if k is not None and k % 2 == 0
               for n in range(3)]
    edits = spark.createDataFrame([*dict.fromkeys(changes), (-5, 0, 0, 0, "x")],
                                  "doc_id bigint, seq bigint, start bigint, length bigint, text string")
    trees = build_trees(docs)
    got = apply_edits(docs, trees, edits).collect()
    assert len(got) == len(rows)
    want = sorted(((k, full(new)) for k, t in rows for new in [edited(t or "", [
        (10 * n, n, f" new{n}'s") for n in range(3)] if k is not None and k % 2 == 0 else [])]), key=repr)
    assert samples.by_row(got, ["doc_id", "n_tokens"]) == want
    again = apply_edits(spark.createDataFrame(got).select("doc_id", "text"),
                        build_trees(spark.createDataFrame(got)), edits.limit(0)).collect()
    assert samples.by_row(again, ["doc_id", "n_tokens"]) == want


def test_query_over_whole_table(spark):
    """Stored trees against encoding every text and every edited text whole."""
    from tuneprep.llm.queries import op8_token_counts, sample_edits

    docs = spark.read.parquet(f"{samples.DATA}/documents.parquet")
    rows = docs.select("doc_id", "text", sample_edits(
        F.col("doc_id"), F.col("text"), F.col("source")).alias("e")).collect()
    got = {r["doc_id"]: r for r in op8_token_counts(spark, samples.DATA).collect()}
    assert len(got) == len(rows)
    for key, text, edits in rows:
        new = edited(text or "", [(e["start"], e["length"], e["text"]) for e in edits])
        r = got[key]
        assert (r["n_chars"], r["n_tokens"], r["n_edits"]) == (len(text or ""), full(text), 4)
        assert (r["edited_chars"], r["edited_tokens"]) == (len(new), full(new))


def test_edits_in_rows_and_empty(spark):
    schema = ("doc_id bigint, text string, edits array<struct<seq:bigint,start:bigint,length:bigint,"
              "text:string>>, n_tokens int")
    rows = [(1, "abc def", [(1, 0, 3, "x"), (0, 4, 3, None)], 0), (2, None, None, 0),
            (3, "abc", [(None, None, None, None), (5, 99, 1, " end")], 0), (None, "", [], 0)]
    got = {r["doc_id"]: r for r in count_edited(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["edited_chars"], got[1]["edited_tokens"]) == (2, full("x "))
    assert (got[2]["n_tokens"], got[2]["n_edits"], got[2]["edited_tokens"]) == (0, 0, 0)
    assert got[3]["edited_tokens"] == full("abc end") and got[None]["edited_tokens"] == 0
    assert count_edited(spark.createDataFrame([], schema)).count() == 0
    assert build_trees(samples.table(spark, [])).count() == 0
