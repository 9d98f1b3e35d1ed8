"""SimHash components against all pairs."""

import numpy as np
import pytest
import samples
import xxhash

from tuneprep.llm import simhash
from tuneprep.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words][:len(words)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(ids, fps):
    group = {i: i for i in range(len(fps))}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, fp in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fp) <= 3):
            a, b = find(i), find(int(j))
            group[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(ids):
        root = find(i)
        if k is not None:
            least[root] = min(least.get(root, k), k)
    return [least.get(find(i)) for i in range(len(ids))]


def test_documents(spark):
    rows = [(k, t) for k, t, _ in samples.documents()] + [(k and k + 10**6, t) for k, t in samples.ROWS]
    rows += [(2 * 10**6 + k, t + " extra end.") for k, t, _ in samples.documents()[:60] if t]
    fps = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    ids = [k for k, _ in rows]
    want = sorted(((k, f"{int(f):016x}", c) for k, f, c in zip(ids, fps, expected(ids, fps))), key=repr)
    got = simhash.near_duplicates(samples.table(spark, rows)).collect()
    assert samples.by_row(got, ["doc_id", "fingerprint", "component_id"]) == want


@pytest.mark.parametrize("crowded", [4096, 8])
def test_links_of_random_fingerprints(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 12, 3)).astype(np.uint64)
    fps = np.unique(np.concatenate([near, (near[:, None] ^ np.bitwise_xor.reduce(flips, 2)).ravel()]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    values = np.sort(fps.view(np.int64))
    want = dict(zip(values.tolist(), expected(values.tolist(), values.view(np.uint64))))
    assert {k: got.get(k, k) for k in want} == want


def test_chain_and_empty(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)], "a bigint, b bigint")
    assert {r["root"] for r in components(chain).collect()} == {0}
    assert simhash.near_duplicates(samples.table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), 4)


def test_representatives_by_row(spark):
    """Rows that share an id, null ids, near copies and equal rows."""
    near = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "a text of its own, said once"), (1, "another text with the same id, unlike it"),
            (2, near), (3, near + " x"), (3, near + " x"), (None, near), (None, "nobody named this one"),
            (None, "nobody named this one"), (None, "nor this, which is not like the others"), (7, ""), (8, None)]
    got = simhash.representatives(samples.table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(
        [rows[0], rows[1], rows[2], rows[6], rows[8], rows[9]], key=repr)
    assert set(samples.EXTRA) <= set(got[0].asDict())
