"""Decontamination against a scan of all windows."""

import hashlib
import re

import duckdb
import samples

from tuneprep.llm.decontam import clean_documents, contamination, find_matches

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        ids = sorted(str(i) for i in found if i is not None)
        yield doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), \
            bool(hit)


def test_contamination(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{samples.DATA}/benchmark.parquet')"
                       ).fetchall()
    items += [(900, "Beta gamma"), (901, None), (902, ""), (903, "words"), (904, "a text WITHOUT an id"),
              (905, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma unknownword")]
    rows = [(k, t) for k, t, _ in samples.documents()] + [(k and k + 10**6, t) for k, t in samples.ROWS]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(samples.table(spark, rows), bench).collect()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert samples.by_row(got, names) == sorted(expected(rows, items), key=repr)


def test_proximity(spark):
    item = "the quick brown fox jumps over the lazy dog today and sleeps"
    docs = samples.table(spark, [
        (1, "once the quick brown young fox jumps over lazy dog today and sleeps"),
        (2, "lazy dog over the brown day"), (3, "so " + item)])
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in contamination(docs, bench).collect()}
    assert (got[1]["contaminated"], got[1]["n_near"]) == (False, 1)
    assert got[2]["n_near"] == 0 and got[3]["contaminated"]
    assert [r["doc_id"] for r in clean_documents(docs, bench).orderBy("doc_id").collect()] == [1, 2]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination(samples.table(spark, []), bench).count() == 0
    got = contamination(samples.table(spark, samples.ROWS), bench).collect()
    assert len(got) == len(samples.ROWS) and not any(r["contaminated"] for r in got)
    assert find_matches(samples.table(spark, samples.ROWS), bench).count() == 0
