"""Language profiles against a plain model, and held-out accuracy on the driver's table."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import samples

from tuneprep.llm import languages as L
from tuneprep.llm.queries import QUERIES


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
    counts = Counter()
    for word in words:
        if word:
            padded = f"_{word}_"
            counts.update(padded[i:i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    del counts["_"]
    return counts


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def plain_rank(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:top]]


def plain_predictions(rows, top):
    learned = {}
    for doc_id, text, lang in rows:
        name = "" if doc_id is None else str(doc_id)
        if lang is not None and text is not None and zlib.crc32(name.encode()) % 3 != 1:
            learned.setdefault(lang, Counter()).update(plain_grams(text))
    tables = {lang: {g: i for i, g in enumerate(plain_rank(c, top))} for lang, c in learned.items() if c}
    out = []
    for doc_id, text, _ in rows:
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1
        own = plain_rank(plain_grams(text), top)
        if not own or not tables:
            out.append((doc_id, held, "und", 0.0))
            continue
        away = sorted((sum(abs(t[g] - i) if g in t else top for i, g in enumerate(own)), lang)
                      for lang, t in tables.items())
        second = away[1][0] if len(away) > 1 else None
        score = 1.0 if second is None else (second - away[0][0]) / second if second else 0.0
        out.append((doc_id, held, away[0][1], score))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for name in samples.EXTRA:
        df = df.withColumn(name, df["doc_id"] * 0)
    found = L.language_report(df, **options).collect()
    return sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in found), key=repr)


LANGS = ["en", "de", None, "x"]


@pytest.mark.parametrize("top", [7, 400])
def test_equals_plain_model(spark, top):
    rows = [(k, t, LANGS[(k or 0) % 4]) for k, t, _ in samples.documents()]
    rows += [(k and k + 2**60 + 1, t, "long") for k, t in samples.ROWS]
    rows += [(9, "²½ 12 ― _", "en"), (10, "İSTANBUL ǅ ß_a'b", "tr"), (11, "a", ""), (12, "none", None)]
    assert got(spark, rows, top=top) == plain_predictions(rows, top)


def test_blocks_and_buffers_change_nothing(monkeypatch):
    text = samples.LONG[:3000] + "Ünïcödé 中文😀"
    want = L.gram_counts(L.letter_codes(text))
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(L, "CHUNK", size)
        have = L.gram_counts(L.letter_codes(text))
        assert (have[0] == want[0]).all() and (have[1] == want[1]).all()
    monkeypatch.setattr(L, "BUFFER", 50)
    monkeypatch.setattr(L, "DISTINCT", 100)
    batches = [pa.RecordBatch.from_pydict({"lang": [lang] * 3, "text": [text] * 3}) for lang in "ab"]
    found = Counter()
    for batch in L._counted(iter(batches)):
        for lang, gram, n in zip(*[c.to_pylist() for c in batch.columns]):
            found[lang, gram] += n
    assert found == {(lang, int(g)): 3 * int(n) for lang in "ab" for g, n in zip(*want)}


def test_empty_and_limits(spark):
    assert got(spark, []) == []
    untaught = [(1, None, None), (2, "words here", None)]
    assert got(spark, untaught) == plain_predictions(untaught, 400)
    with pytest.raises(ValueError):
        got(spark, [(k, "some words", f"l{k}") for k in range(20)], max_languages=3)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").select(
        "doc_id", "lang").collect()}
    found = [r for r in QUERIES["op11_language_id"](spark, path).collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in found]) > 0.98
