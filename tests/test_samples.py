"""Samples assembled from line rows against the pattern over the whole text of a log."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tuneprep.operators import samples as S
from tuneprep.rules.terms import SAMPLE_BLOCK

PIECES = ['predict_', 'predict_7', 'predict_12 x', '"input":', '"input": "', '"input":"a', '"predict": "',
          '"predict":', '"label": "', '"label":\t', '"', '""', "\n", "\n", "\n \t\n", " ", "é中", 'x', '"x": 1',
          'predict_3 "input": "i', '",\n"predict": "p', '", "label": "l"', '"input": "predict": "label": "']


def expected(log, keep=3):
    found = re.findall(SAMPLE_BLOCK.replace(r"\d", "[0-9]").replace(r"\s", S.SPACE), log)[-keep:]
    return [(n, *s) for n, s in enumerate(found)]


def lines_of(spark, logs, seed=0, schema="log_id bigint, ord bigint, line string"):
    rows = [(k, i, line) for k, log in logs.items() for i, line in enumerate(log.split("\n"))]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(5)


def got(df, **options):
    out = {}
    for r in S.sample_outputs(df, **options).collect():
        out.setdefault(r["log_id"], []).append(
            (r["n"], r["step"], r["input"], r["predict"], r["label"]))
    return {k: sorted(v) for k, v in out.items()}


def fuzzed(count, size, seed):
    draw = random.Random(seed)
    return {k: "".join(draw.choices(PIECES, k=draw.randint(1, size))) for k in range(count)}


@pytest.mark.parametrize("width", [1, 3, 65_536])
def test_any_text(spark, width):
    logs = fuzzed(400, 60, width)
    want = {k: e for k, log in logs.items() if (e := expected(log))}
    assert len(want) > 100
    assert got(lines_of(spark, logs), width=width) == want


@pytest.mark.parametrize("width,keep", [(2, 2), (7, 5)])
def test_reductions_compose(width, keep):
    for log in fuzzed(3000, 120, 11).values():
        rows = [(i, *t) for i, line in enumerate(log.split("\n")) for t in S.tokens(line)]
        blocks = [(b, S.reduced((r for r in rows if r[0] // width == b), b, width, keep))
                  for b in sorted({r[0] // width for r in rows})]
        steps = [s[0] for s in S.composed(iter(blocks), keep)]
        assert steps == [s[1] for s in expected(log, keep)]


def test_one_log_in_many_tasks_and_merge_join(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_SPANS", 0)
    sample = 'predict_%d {\n\n"input":\n  "q%d\n' + "line of text\n" * 400 + '", "predict": "p",\n"label": "l%d"}\n'
    logs = {5: "".join(sample % (i, i, i) for i in range(12)) + 'predict_99 "input": "open',
            6: "nothing here\n" * 50}
    df = lines_of(spark, logs)
    assert got(df, width=64) == {5: expected(logs[5])}
    cut = got(df, width=64, limits={"input": 4, "label": 1})
    assert cut == {5: [(n, s, i[:4], p, q[:1]) for n, s, i, p, q in expected(logs[5])]}


def test_awkward_rows(spark):
    log = 'predict_1\n"input": "a\n\nb" "predict": "" "label": "c"'
    rows = [(None, i, line or None) for i, line in enumerate(log.split("\n"))]
    rows += [("s", i, line) for i, line in enumerate(log.split("\n"))]
    rows += [("s", None, '"'), ("s", -1, "predict_5"), ("t", 0, None), ("u", 0, 'predict_1 "input":'),
             ("u", 2, '"a" "predict": "b" "label": "c"')]
    df = spark.createDataFrame(rows, "log_id string, ord int, line string").withColumn("n", F.lit(1))
    one = [(0, "1", "a\n\nb", "", "c")]
    assert got(df.withColumn("step", F.lit("x"))) == {None: one, "s": one}
    assert got(df.limit(0)) == {}
