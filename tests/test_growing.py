"""Logs that grow in place: the source line by line, and snapshots kept in the state store."""

import json
import random
import time

import pyarrow.fs as fs
import pytest

from tuneprep.operators import monitor as MO
from tuneprep.sources import growing as G
from tuneprep.streaming import progress as SP

POINT = '{"step": %d, "epoch": 1.5, "loss": %s, "elapsed_seconds": %d}\n'


def read(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        out += [row for batch in reader.read(part) for row in batch.to_pylist()]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_every_line_once(tmp_path, monkeypatch, seed):
    draw = random.Random(seed)
    monkeypatch.setattr(G, "BLOCK", draw.choice([3, 16, 1 << 20]))
    monkeypatch.setattr(G, "LEAST_BYTES", draw.choice([1, 40]))
    texts = {}
    for k in range(4):
        (tmp_path / f"e{k}").mkdir()
        rows = [draw.choice(["", "noise é中", "x" * 90, '{"loss": %d}' % i, "{'a': 1} tail"])
                for i in range(draw.randint(0, 40))]
        texts[f"e{k}"] = ("\n".join(rows) + "\n").encode()
    reader = G.GrowingLinesReader(f"{tmp_path}/*", draw.choice([5, 64, 1 << 20]), 3)
    before, got = reader.initialOffset(), []
    written = dict.fromkeys(texts, 0)
    while any(written[k] < len(texts[k]) for k in texts):
        for k, text in texts.items():
            add = draw.randint(0, 60)
            with open(tmp_path / k / "train.log", "ab") as file:
                file.write(text[written[k]:written[k] + add])
            written[k] += add
        now = reader.latestOffset()
        got += read(reader, before, now)
        before = now
    assert read(reader, before, reader.latestOffset()) == []
    for k, text in texts.items():
        want, at = [], 0
        for line in text.split(b"\n")[:-1]:
            want.append((at, line.decode()))
            at += len(line) + 1
        found = sorted((r["position"], r["line"]) for r in got if r["folder"] == k)
        # Text added to a closed object without a line break comes as its line again, or not at all.
        exact = [w for w in want if w[1] != "{'a': 1} tail"]
        assert [f for f in found if f in exact] == exact
        assert {p for p, _ in found} == {p for p, _ in want}


def test_half_a_line(tmp_path):
    (tmp_path / "run=e").mkdir()
    log = tmp_path / "run=e" / "a.log"
    reader = G.GrowingLinesReader(f"{tmp_path}/*", 1 << 20, 1)
    seen = [reader.initialOffset()]

    def step(text):
        with open(log, "a") as file:
            file.write(text)
        seen.append(reader.latestOffset())
        return [(r["folder"], r["position"], r["line"]) for r in read(reader, *seen[-2:])]

    assert step('{"loss": 1}\n{"lo') == [("e", 0, '{"loss": 1}')]
    assert step('ss": 2') == []
    assert step("}") == [("e", 12, '{"loss": 2}')]     # closed, so it need not wait
    assert step("\r\nnoise") == []
    assert step("\n") == [("e", 25, "noise")]
    log.write_text("new\n")                            # shorter: read from the start
    assert step("") == [("e", 0, "new")]
    (tmp_path / "run=e" / "_hidden").write_text("x\n")
    assert step("") == []


def test_one_big_file_in_many_tasks(tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.log").write_text("".join(f"line {i}\n" for i in range(300_000)))
    reader = G.GrowingLinesReader(f"{tmp_path}/e", 1 << 30, 3)
    parts = reader.partitions({}, reader.latestOffset())
    rows = [[r["line"] for b in reader.read(p) for r in b.to_pylist()] for p in parts]
    assert len(parts) >= 3 and max(map(len, rows)) < 150_000
    assert sum(rows, []) == [f"line {i}" for i in range(300_000)]
    assert isinstance(reader._system(str(tmp_path))[0], fs.LocalFileSystem)


@pytest.mark.parametrize("expire", [1, 3600])
def test_snapshots_follow_growing_logs(spark, tmp_path, monkeypatch, expire):
    """Appends between triggers, each a restarted query; states that expire between; compaction."""
    monkeypatch.setattr(SP, "COMPACT", 3)
    logs, texts = tmp_path / "logs", {"a": "", "b": ""}
    for name in texts:
        (logs / name).mkdir(parents=True)

    def trigger(**new):
        time.sleep(1.1 if expire == 1 else 0)
        for name, text in new.items():
            texts[name] += text
            with open(logs / name / "train.log", "a") as file:
                file.write(text)
        SP.write_snapshots(SP.log_stream(spark, f"{logs}/*"), str(tmp_path / "out"),
                           str(tmp_path / "c"), expire, availableNow=True).awaitTermination()
        whole = [(n, i, line) for n, t in texts.items()
                 for i, line in enumerate(t[:t.rfind("\n") + 1].split("\n"))]
        batch = MO.progress(MO.parse_log(spark.createDataFrame(
            whole, "experiment_id string, ord bigint, line string")))
        got = SP.latest_snapshots(spark, str(tmp_path / "out"))
        assert sorted(got.collect()) == sorted(batch.select(*got.columns).collect())

    def points(first, n):
        return "".join(POINT % (i, 1 + i * 7 % 5, i * i) for i in range(first, first + n))

    trigger(a=points(0, 14), b="noise\n" + points(3, 1))
    trigger(a=points(14, 4) + '{"step": 99, "lo')
    trigger(a='ss": 0.5, "elapsed_seconds": 900}\n')
    trigger(a=points(20, 3), b=points(9, 12))
    assert SP.numbered_folders(spark, str(tmp_path / "out"), "base") == [2]
    rows = spark.read.parquet(str(tmp_path / "out" / "updates" / "version=3"))
    assert {r["experiment_id"] for r in rows.collect()} == {"a", "b"}
    trigger(b=points(40, 2))
    rows = spark.read.parquet(str(tmp_path / "out" / "updates" / "version=4")).collect()
    assert [r["experiment_id"] for r in rows] == ["b"]
    assert json.loads(rows[0]["snapshot"])["points"] == (2 if expire == 1 else 15)


def test_logs_are_written_as_a_partitioned_table_is(spark, tmp_path):
    """Same folders and lines as Spark's writer, also for names to escape; one file per task and log."""
    names = ["a", "b=c/d", "50%", "", None, "é中", "[x]\\"]
    rows = [(n, i, None if i == 3 else f"line {i} of {n} é" * (i % 4)) for n in names for i in range(50)]
    lines = spark.createDataFrame(rows, "run string, ord int, line string")

    def contents(path):
        return {d.name: "".join(f.read_text() for f in sorted(d.iterdir()) if f.name[0] not in "._")
                for d in path.iterdir() if d.is_dir()}

    parts = lines.repartition(3, "run")
    parts.sortWithinPartitions("run", "ord").select("run", "line").write.partitionBy("run").text(str(tmp_path / "spark"))
    for _ in range(2):  # again: the files are replaced
        G.write_logs(parts, str(tmp_path / "ours"), "run", "ord")
    got, want = contents(tmp_path / "ours"), contents(tmp_path / "spark")
    null = "run=__HIVE_DEFAULT_PARTITION__"
    assert sorted(got.pop(null).split("\n")) == sorted(want.pop(null).split("\n"))
    assert got == want and len(got) == 5
    assert [f.name[:5] for f in (tmp_path / "ours" / "run=a").iterdir()] == ["part-"]


def test_a_log_longer_than_a_batch_is_one_file(spark, tmp_path):
    lines = spark.range(25_000).selectExpr("'e' AS run", "id AS ord", "'line ' || id AS line").coalesce(1)
    G.write_logs(lines, str(tmp_path), "run", "ord")
    (file,) = (tmp_path / "run=e").iterdir()
    assert file.read_text() == "".join(f"line {i}\n" for i in range(25_000))
