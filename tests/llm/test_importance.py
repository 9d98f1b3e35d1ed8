"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import samples

from tuneprep.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(rows, target):
    source = Counter(bucket(f) for _, t in rows for f in plain_features(t)[1])
    wanted = Counter(bucket(f) for t in target for f in plain_features(t)[1])
    s_all, t_all = source.total(), wanted.total()

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000)
                                          / ((source[b] + 1) * (t_all + 10_000))))

    out = []
    for key, text in rows:
        words, features = plain_features(text)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([key, len(features), weight, score, len(words)])
    drawn = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    k = 5 * len(drawn) // 100
    ranks = Counter((tuple(r), i + 1) for i, r in enumerate(drawn[:k]))
    return out, drawn, k, ranks


def check(spark, rows, target, **options):
    out, drawn, k, ranks = plain(rows, target)
    found = I.resample(samples.table(spark, rows), spark.createDataFrame(
        [(t,) for t in target], "text string"), **options).collect()
    names = ["doc_id", "n_features", "weight", "score"]
    assert Counter(tuple(r[n] for n in names) for r in found) == Counter(tuple(r[:4]) for r in out)
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, k + 1))
    # Rows of one id and score are interchangeable.
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[3]) for r in drawn[:k]]


def test_documents(spark):
    rows = [(k, t) for k, t, _ in samples.documents()] + samples.ROWS
    check(spark, rows, ["Alpha beta gamma; delta-words", None, "", "the THE the, été 中文 words"])


def test_hot_ids_and_equal_scores(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(7, text)] * 90 + [(None, text)] * 90 + [(2**60 + k, text + "x " * k) for k in range(60)]
    check(spark, rows, ["one two three"])
    check(spark, [(1, "short")], [])
    check(spark, [], ["words"])


@pytest.mark.parametrize("pivots", [1, 3, 31])
def test_quickselect(spark, pivots):
    rows = [(k if k % 5 else None, (k * 7919) % 40, k) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, score bigint, row bigint")
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    for k in (1, 2, 57, 199, 200):
        key = I.kth_key(df, k, pivots)
        assert df.where(I._key() <= key).count() == k
        last = df.where(I._key() == key).first()
        assert tuple(last) == order[k - 1]


def test_blocks_change_nothing(monkeypatch):
    text = "Some words, of ÜNICODE 中文 text; and 1 more\nword " * 30
    want = Counter(bucket(f) for f in plain_features(text)[1])
    for size in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(I, "BLOCK", size)
        found = list(I.feature_blocks(text))
        assert Counter(b for _, f in found for b in f.tolist()) == want
        assert sum(n for n, _ in found) == len(plain_features(text)[0])
