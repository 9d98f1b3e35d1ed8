"""Losses against a model in plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import samples
from pyspark.sql import functions as F

from tuneprep.llm import common, ngrams
from tuneprep.llm.ngrams import FOLDS, ModelOptions, fold_of, score

OPTIONS = ModelOptions(vocabulary=300, max_bigrams=500)


def plain(rows, good, options):
    """rows: (id, text, fold). Yields (id, tokens, target loss, background loss)."""
    counts = Counter(w for _, t, _ in rows for w in (t or "").lower().split())
    vocabulary = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    known = set(vocabulary[:options.vocabulary])
    size = len(known) + 2

    def pairs(text):
        words = [w if w in known else None for w in (text or "").lower().split()]
        return list(zip(["<s>", *words], words))

    models = []
    for fold in range(FOLDS):
        c = [Counter(p for k, t, f in rows if f != fold and (k in good) == side for p in pairs(t))
             for side in (True, False)]
        joint = Counter(c[0]) + Counter(c[1])
        limit = next(n for n in range(1, 10**6)
                     if sum(v >= n for v in joint.values()) <= options.max_bigrams)
        kept = {p for p, v in joint.items() if v >= limit}
        for part in c:
            above, token = Counter(), Counter()
            for (a, b), v in part.items():
                above[a] += v
                token[b] += v
            mass = Counter()
            for p in kept:
                mass[p[0]] += max(part[p] - options.discount, 0)
            total = sum(token.values())

            def loss(p, part=part, above=above, token=token, mass=mass, total=total, kept=kept):
                n = above[p[0]]
                rest = 1 - mass[p[0]] / n if n else 1
                uni = (token[p[1]] + 1) / (total + size)
                first = max(part[p] - options.discount, 0) / max(n, 1) if p in kept else 0
                return -math.log(first + rest * uni)

            models.append(loss)
    for k, t, f in rows:
        tokens = pairs(t)
        yield k, len(tokens), *[sum(map(models[2 * f + side], tokens)) / len(tokens)
                                if tokens else None for side in (0, 1)]


def test_scores(spark):
    rows = [(k, t) for k, t, _ in samples.documents()] + [(k and k + 10**6, t) for k, t in samples.ROWS]
    docs = samples.table(spark, rows)
    good = {k for k, _ in rows if k is not None and k % 3 == 0}
    labels = spark.createDataFrame([(k, int(k in good)) for k, _ in rows if k is not None]
                                   + [(0, 1), (None, 1), (7, None)], "doc_id bigint, quality int")
    folded = [tuple(r) for r in docs.select("doc_id", "text", fold_of(F.col("text"))).collect()]
    want = {k: v for k, *v in plain(folded, good, OPTIONS)}
    got = score(docs, labels, OPTIONS).collect()
    assert len(got) == len(rows)
    for r in got:
        n, target, background = want[r["doc_id"]] if r["doc_id"] is not None else (None,) * 3
        if n:
            assert r["n_tokens"] == n
            assert r["target_loss"] == pytest.approx(target)
            assert r["difference"] == pytest.approx(target - background)
        elif n == 0:
            assert r["target_loss"] is None and r["difference"] is None


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert score(samples.table(spark, []), labels).count() == 0
    got = score(samples.table(spark, samples.ROWS), labels).collect()
    assert len(got) == len(samples.ROWS)


def test_all_words_and_bigrams_are_kept(spark):
    rows = [(k, t) for k, t, _ in samples.documents()]
    docs = samples.table(spark, rows)
    good = {k for k, _ in rows if k % 3 == 0}
    labels = spark.createDataFrame([(k, int(k in good)) for k, _ in rows], "doc_id bigint, quality int")
    folded = [tuple(r) for r in docs.select("doc_id", "text", fold_of(F.col("text"))).collect()]
    want = {k: v for k, *v in plain(folded, good, ModelOptions(vocabulary=10**9, max_bigrams=10**9))}
    assert ModelOptions().vocabulary is None and ModelOptions().max_bigrams is None
    for options in (ModelOptions(), ModelOptions(frequent=100)):
        got = score(docs, labels, options).collect()
        assert len(got) == len(rows)
        for r in got:
            n, target, background = want[r["doc_id"]]
            assert r["n_tokens"] == n and r["target_loss"] == pytest.approx(target)
            assert r["difference"] == pytest.approx(target - background)


@pytest.mark.parametrize("options", [ModelOptions(), ModelOptions(frequent=3), OPTIONS])
def test_many_chunks_and_buckets_without_a_written_model(spark, monkeypatch, options):
    """Texts are shuffled once, each chunk sends a bigram once, and no table of bigrams is written."""
    def written(*_):
        raise AssertionError("a table was written")

    monkeypatch.setattr(common, "scratch_path", written)
    monkeypatch.setattr(ngrams, "CHUNK_CHARS", 10_000)
    monkeypatch.setattr(ngrams, "BUCKET_CHARS", 15_000)
    rows = [(k, t) for k, t, _ in samples.documents()] + [
        (10**6 + k, "the " * 50 + f"word{k} the " * (k % 4)) for k in range(40)]
    docs = samples.table(spark, rows)
    good = {k for k, _ in rows if k % 3 == 0}
    labels = spark.createDataFrame([(k, int(k in good)) for k, _ in rows], "doc_id bigint, quality int")
    folded = [tuple(r) for r in docs.select("doc_id", "text", fold_of(F.col("text"))).collect()]
    full = ModelOptions(vocabulary=options.vocabulary or 10**9, max_bigrams=options.max_bigrams or 10**9)
    want = {k: v for k, *v in plain(folded, good, full)}
    found = score(docs, labels, options)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        n, target, background = want[r["doc_id"]]
        assert r["n_tokens"] == n and r["target_loss"] == pytest.approx(target)
        assert r["difference"] == pytest.approx(target - background)
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_a_bigram_is_sent_once():
    places = ngrams.Places(5, np.sort(ngrams.hashes(["a", "b"])))
    rows = pa.table({"chunk": pa.array([3] * 15, pa.int32()), "fold": pa.array([1] * 15, pa.int32()),
                     "doc_id": [2, None, *[1] * 13], "text": ["A b", None, *["a b a b c"] * 12, None],
                     "good": [False] * 14 + [True]})
    sent = ngrams.asked(rows, None, places)
    assert sent["bucket"].to_pylist() == [0, 1, 2, 3, 4]
    kind = ngrams.kinds(*[pc.list_value_length(sent[c]).to_numpy() for c in ("words", "next")])
    target, background = (n[kind == 1] for n in ngrams.unpacked(sent))
    before = np.repeat(ngrams.flat(sent["words"]), ngrams.flat(sent["sizes"]))
    found = list(zip(before, ngrams.flat(sent["next"]), target, background))
    a, b, c = ngrams.hashes(["a", "b", "c"])
    assert sorted(found) == sorted([(ngrams.BEGIN, a, 12, 1), (a, b, 24, 1), (b, a, 12, 0), (b, c, 12, 0)])
    assert [n[kind == 0].sum() for n in ngrams.unpacked(sent)] == [12, 1]
