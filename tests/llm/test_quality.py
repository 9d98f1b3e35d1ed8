"""Quality rules against plain Python."""

import re
from collections import Counter

import samples
from pyspark.sql import functions as F

from tuneprep.llm.quality import QualityOptions, apply_rules, judged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "base_failed"]


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {k for i, g in enumerate(grams) if seen[g] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_counts(spark):
    rows = [(k, t) for k, t, _ in samples.documents()] + samples.ROWS
    got = judged(samples.table(spark, rows)).collect()
    assert samples.by_row(got, NAMES) == sorted([(k, *expected(t)) for k, t in rows], key=repr)


def test_frequent_lines(spark):
    body = [f"{' '.join(f'w{i}n{k}' for k in range(30))}" for i in range(40)]
    rows = [(i, f"{t}\n  Shared   LINE of the site.", "a") for i, t in enumerate(body)]
    rows += [(100 + i, f"{t}\nshared line of the site.", "b") for i, t in enumerate(body[:5])]
    rows += [(200 + i, rows[0][1], "a") for i in range(60)]                 # copies count once
    rows += [(300 + i, "only shared words here " * 6 + f"\nz{i}", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    options = QualityOptions(min_line_docs=10, max_repeat_share=1.0)
    got = {r["doc_id"]: r for r in judged(docs, options).collect()}
    assert got[0]["removed_words"] == 0 and got[0]["kept"]                 # the first document
    assert got[1]["removed_words"] == 5 and got[1]["kept"]
    assert got[100]["removed_words"] == 0                                   # another host
    assert [got[300 + i]["kept"] for i in range(20)] == [True] + [False] * 19
    kept = {r["doc_id"]: r["text"] for r in apply_rules(docs, options).collect()}
    assert kept[1] == body[1] and kept[0] == rows[0][1] and 301 not in kept


def test_apply_keeps_columns_and_empty_tables(spark):
    docs = samples.table(spark, samples.ROWS)
    kept = apply_rules(docs, QualityOptions(max_repeat_share=1.0))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 6]
    none = samples.table(spark, [])
    assert judged(none).count() == 0 and apply_rules(none).where(F.lit(True)).count() == 0
