"""The pipeline's stages against plain Python, and on awkward tables."""

import os

import corpus_pipeline
import numpy as np
import samples
from test_decontam import expected as contaminated
from test_quality import expected as counted
from test_simhash import expected as grouped
from test_simhash import plain_fingerprint


def test_documents(spark):
    docs = spark.read.parquet(f"{samples.DATA}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{samples.DATA}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [(k, t) for k, t in rows if not counted(t)[-1]]         # no line is frequent in 200 texts
    fps = np.array([plain_fingerprint(t) for _, t in kept], dtype=np.uint64)
    groups = grouped([k for k, _ in kept], fps)
    kept = [(k, t) for (k, t), c in zip(kept, groups) if k == c]
    dirty = {r[0] for r in contaminated(kept, bench) if r[-1]}
    want = sorted(k for k, _ in kept if k not in dirty)
    step = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        step = stage(spark, step, samples.DATA)
        assert step.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in step.collect()) == want
    packed = corpus_pipeline.run(spark, samples.DATA).collect()
    assert sorted({r["doc_id"] for r in packed}) == want


def test_awkward_rows(spark, tmp_path):
    rows = [(k, t, "en", "s", 0, "x") for k, t in samples.ROWS]
    rows += [(50 + i, " ".join(f"w{i}x{k}" for k in range(40)), None, None, None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, "
                                 "n_chars bigint, row string")
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(
        os.path.join(tmp_path, "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {50, 51, 52}
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
