"""VA-file clustering against plain Lloyd rounds in Python integers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import samples
from pyspark.sql import functions as F

from tuneprep.llm import vafile as V

LONG_MAX = (1 << 63) - 1


def plain(rows, dims=4, clusters=3, rounds=6, scale=1024):
    kept = [(k, [math.floor(scale * x) for x in v]) for k, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(
        f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), i) for i, p in enumerate(points))

    for _ in range(rounds):
        groups = [[v for _, v in kept if near(v)[1] == i] for i in range(len(points))]
        points = [[sum(c) // len(g) for c in zip(*g)] if g else p for g, p in zip(groups, points)]
    found = [(k, *near(v)[::-1]) for k, v in kept]
    sums = Counter()
    for _, c, away in found:
        sums[c] += away

    def long(x):
        return x if x <= LONG_MAX else None

    whole = any(d > LONG_MAX for _, _, d in found)
    broken = {c for _, c, d in found if d > LONG_MAX}
    return sorted(((k, c, long(d), None if c in broken else long(sums[c]),
                    None if whole else long(sum(sums.values())),
                    hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest())
                   for k, c, d in found), key=repr)


def got(spark, rows, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    df = df.select("*", *[F.lit(-1).alias(c) for c in [*samples.EXTRA, "distance", "c", "residual"]])
    options = {"dims": 4, "clusters": 3, "rounds": 6} | options
    return sorted(map(tuple, V.cluster(df, **options).collect()), key=repr)


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(2**60 + i, (rng.integers(0, 5) + rng.normal(0, 0.1, 4)).tolist()) for i in range(n)]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(120) + vectors(20) + [(1, None), (2, [1.0]), (3, [1.0, 2.0, nan, 0.0]),
        (4, [inf, 0.0, 0.0, 0.0]), (5, [1.0, None, 1.0, 1.0]), (None, [0.5, 0.5, 0.5, 0.5]),
        (None, [0.25, 0.5, 0.5, 0.5])] + [(6, [1.0, 1.0, 1.0, 1.0])] * 80
    assert got(spark, rows) == plain(rows)


def test_fetch_by_merge_join_and_coarse_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_ROWS", 0)
    rows = vectors(150, 2)
    assert got(spark, rows, bits=2) == got(spark, rows, bits=7) == plain(rows)


def test_few_and_no_vectors(spark):
    two = vectors(2)
    assert got(spark, two) == plain(two)
    same = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(5)]
    assert got(spark, same) == plain(same)
    assert got(spark, []) == [] == got(spark, [(1, None)])


def test_huge_components(spark):
    rows = vectors(30) + [(9, [1e30, -1e30, 1e9, 0.0]), (10, [-3e6, 70_000.0, 0.0, 1.0])]
    assert got(spark, rows) == plain(rows)


def test_cells_decide_only_what_is_certain():
    rng = np.random.default_rng(5)
    values = np.floor(1024 * (rng.integers(0, 6, (400, 1)) + rng.normal(0, 0.2, (400, 8))))
    values[0] *= 1000  # far outside of the sample's range
    cells = V.Cells(values[100:150], 4)
    packed, away = cells.approximate(values)
    points = values[[0, 7, 7, 30, 60]].astype(np.int64)
    sure = V.Intervals(cells, points).clusters(cells.unpack(pa.array(packed, pa.binary())), away)
    exact = V.nearest(values.astype(np.int64), points)
    assert (sure[sure >= 0] == exact[sure >= 0]).all() and (sure >= 0).mean() > 0.5
