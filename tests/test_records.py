"""Arrays and quoted CSV cut into many blocks, against the whole text."""

import csv
import io
import json
import random

import pytest

from tuneprep.sources import files as S
from tuneprep.sources import records as R

BITS = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é中", "x", "\\\"", "}\n{", "a,b"]


@pytest.fixture
def small_blocks(spark):
    """Files are cut every few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts(seed, count, size):
    draw = random.Random(seed)
    return ["".join(draw.choices(BITS, k=draw.randint(0, size))) for _ in range(count)]


def blocks_of(text, kind, seed):
    """Fragments dealt to blocks at random."""
    draw, block, out = random.Random(seed), 0, []
    parts = text.split(kind.separator)
    for part in parts[:-1] if parts[-1] == "" else parts:
        out.append(("f", block, part))
        block += draw.random() < 0.4
    return out


def cut(rows, kind):
    starts = {(f, b): s for f, b, *s in R.states(R.effects(kind, iter(rows)))}
    found = list(R.pieces(kind, ((f, b, t, *starts[f, b]) for f, b, t in rows)))
    ends = sorted((r for r in found if r[2] != R.WHOLE), key=lambda r: r[1:3])
    return [(r[4], r[5]) for r in found if r[2] == R.WHOLE] + list(R.joined(iter(ends)))


@pytest.mark.parametrize("indent", [None, 1])
def test_array_blocks(indent):
    for seed in range(150):
        rows = [{"a": t, "b": [{"c": t}], t[:2]: {}} for t in texts(seed, 12, 9)]
        mixed = [x for r in rows for x in (r, 5, "{", [r], None)] if seed % 2 else rows
        found = cut(blocks_of(json.dumps(mixed, indent=indent, ensure_ascii=False), R.JsonArray(), seed),
                    R.JsonArray())
        key = json.dumps
        assert sorted((json.loads(v) for _, v in found), key=key) == sorted(rows, key=key)


def test_csv_blocks():
    for seed in range(300):
        draw, out = random.Random(seed), io.StringIO()
        rows = [[t, draw.choice(["", "u", "v w"]), t[::-1]] for t in texts(seed, 15, 7)]
        csv.writer(out, lineterminator="\n", quoting=draw.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL])
                   ).writerows([["a", "b", "c"], *rows])
        found = cut(blocks_of(out.getvalue(), R.CsvRows(), seed), R.CsvRows())
        assert [flag for flag, _ in found].count(True) == 1
        parsed = [next(csv.reader(io.StringIO(v, newline=""))) for flag, v in found if not flag]
        assert sorted(parsed) == sorted(rows)
    assert R.CsvRows().step(0, 0, 'a,b"c,d"')[0] == 0   # quotes inside an unquoted field are text
    assert R.CsvRows().step(0, 0, '"a""b",x,"c')[0] == 1


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_file_in_many_tasks(spark, tmp_path, small_blocks, indent):
    rows = [{"ord": i, "text": t, "tags": [t, "}"]} for i, t in enumerate(texts(1, 200, 40))]
    path = tmp_path / "x.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    got = S.read_json(spark, str(path))
    assert got.rdd.getNumPartitions() > 5
    assert sorted((r.asDict() for r in got.collect()), key=lambda r: r["ord"]) == rows
    whole = spark.read.option("multiLine", "true").json(str(path))
    assert got.schema == whole.schema and got.exceptAll(whole).isEmpty()
    typed = S.read_json(spark, str(path), "ord bigint, text string")
    assert typed.count() == 200


@pytest.mark.parametrize("typed", [True, False])
def test_quoted_csv_in_many_tasks(spark, tmp_path, small_blocks, typed):
    with open(tmp_path / "x.csv", "w", encoding="utf-8", newline="") as file:
        csv.writer(file, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(
            [["ord", "text"], *([i, t + "\n" + "line,\n" * (i % 9)] for i, t in enumerate(texts(2, 150, 30)))])
    schema = "ord int, text string" if typed else None
    got = S.read_csv(spark, str(tmp_path / "x.csv"), schema)          # larger than a task's share
    whole = S.read_csv(spark, str(tmp_path / "x.csv"), schema, split=False)
    assert got.schema == whole.schema and got.rdd.getNumPartitions() > 5
    assert sorted(got.collect()) == sorted(whole.collect()) and got.count() == 150


def test_awkward_files(spark, tmp_path, small_blocks, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_BLOCKS", 0)
    for n, text in enumerate(["[]", " \n[\n{\"a\": 1},\n\n{\"a\": 2}\n]\n\n", '[{"a": 3}, {"a": 4', "", "  \n"]):
        (tmp_path / f"{n}.json").write_text(text)
    long = "y" * 5000
    (tmp_path / "9.json").write_text(json.dumps([{"a": 5, "t": long}, {"a": 6}]))
    got = S.read_json(spark, str(tmp_path)).orderBy("a").collect()
    assert [r["a"] for r in got] == [1, 2, 3, 4, 5, 6] and got[4]["t"] == long
    with pytest.raises(S.ImportFailed):
        S.read_json(spark, str(tmp_path / "0.json"))
    (tmp_path / "h.csv").write_text('\n"a","b"\r\n1,"x\ny"\r\n\n2,"z')
    rows = S.read_csv(spark, str(tmp_path / "h.csv"), split=True).collect()
    assert [tuple(r) for r in rows] == [(1, "x\ny"), (2, "z")]
    (tmp_path / "e.csv").write_text("a,b\n")
    assert S.read_csv(spark, str(tmp_path / "e.csv"), split=True).columns == ["a", "b"]
