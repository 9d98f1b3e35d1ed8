import json

import pytest
from helpers import THREE, records

from tuneprep.sources import datasets as D
from tuneprep.sources import files as S
from tuneprep.sources import inventory as I


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


ROW = {"instruction": "q", "input": "", "output": "a"}


@pytest.mark.parametrize("text,count", [
    ("\n".join([json.dumps(ROW), "{broken", "", json.dumps(ROW)]), 2),
    (json.dumps([ROW, ROW, ROW]), 3),
    (json.dumps([ROW, ROW], indent=2), 2),
    (json.dumps({"items": [ROW, ROW]}, indent=2), 2),
    (json.dumps({"data": [ROW, ROW]}), 2),
    (json.dumps(ROW, indent=2), 1),
    (json.dumps(ROW), 1),
])
def test_json_shapes(spark, tmp_path, text, count):
    rows = S.read_json(spark, write(tmp_path, "x.json", text))
    assert rows.count() == count
    assert {r.instruction for r in rows.collect()} == {"q"}


def test_csv(spark, tmp_path):
    path = write(tmp_path, "x.csv", 'instruction,input,output,n\n"a, ""b""\nc",,out,3\n')
    row = S.read_csv(spark, path).first()
    assert (row.instruction, row.input, row.output, row.n) == ('a, "b"\nc', None, "out", 3)
    got = S.import_dataset(spark, path)
    assert got.format == "alpaca"
    assert [m.content for m in got.records.first().messages] == ['a, "b"\nc', "out"]


def test_tsv(spark, tmp_path):
    path = write(tmp_path, "x.txt", " q1\ta1\textra \n\nonly one\n\t\n")
    got = S.import_dataset(spark, path)
    assert [[m.content for m in r.messages] for r in got.records.collect()] == [["q1", "a1"], ["only one"]]
    assert S.import_dataset(spark, path, compat=True).records.count() == 1


def test_import_errors(spark, tmp_path):
    with pytest.raises(S.ImportFailed, match="exist"):
        S.import_dataset(spark, str(tmp_path / "no.json"))
    with pytest.raises(S.ImportFailed, match="unsupported"):
        S.import_dataset(spark, write(tmp_path, "x.doc", "x"))
    for name, text in (("e.json", "  \n"), ("e.json2.txt", "\n"), ("e.csv", "a,b\n")):
        with pytest.raises(S.ImportFailed, match="no records"):
            S.import_dataset(spark, write(tmp_path, name, text))


def test_save_load_list_remove(spark, tmp_path):
    base = str(tmp_path / "ds")
    data = records(spark, THREE * 4 + [[]])
    D.save_dataset(data, base, "plain")
    D.save_dataset(data, base, "rows", "alpaca", file_format="json")
    plain, rows = D.load_dataset(spark, base, "plain"), D.load_dataset(spark, base, "rows")
    assert (plain.format, plain.record_count) == ("sharegpt", 13)
    assert (rows.format, rows.record_count) == ("alpaca", 12)
    listed = {r.id: r for r in D.list_datasets(spark, base).collect()}
    assert {n: r.record_count for n, r in listed.items()} == {"plain": 13, "rows": 13}
    S.delete_path(spark, f"{base}/rows/meta")
    assert D.load_dataset(spark, base, "rows").format == "alpaca"
    D.remove_dataset(spark, base, "rows")
    for action in (D.load_dataset, D.remove_dataset):
        with pytest.raises(FileNotFoundError):
            action(spark, base, "rows")


def test_export(spark, tmp_path):
    D.export_for_trainer(records(spark, THREE), str(tmp_path / "x"), "mine")
    assert spark.read.json(str(tmp_path / "x" / "data")).count() == 3
    entry = spark.read.json(str(tmp_path / "x" / "dataset_info")).first().mine
    assert entry.formatting == "sharegpt" and entry.tags.user_tag == "user"


def test_inventories(spark, tmp_path):
    root = tmp_path / "models"
    for name, size in [("a--m/config.json", 10), ("a--m/sub/x.bin", 20), ("b/notes.txt", 5),
                       ("b/sub/w.gguf", 7)]:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    files = I.list_files(spark, str(root))
    got = {r.model_id: r for r in I.library_inventory(files, str(root)).collect()}
    assert (got["a/m"].file_count, got["a/m"].is_downloaded) == (2, True)
    assert (got["b"].file_count, got["b"].is_downloaded) == (2, False)
    assert got["a/m"].size_gb == 30 / 1024 ** 3
    exp = tmp_path / "exp"
    for step in (100, 20):
        (exp / f"checkpoint-{step}" / "deep").mkdir(parents=True)
        (exp / f"checkpoint-{step}" / "deep" / "w").write_bytes(b"x" * step)
    ckpt = {r.step: r.size_mb for r in I.checkpoint_inventory(I.list_files(spark, str(exp))).collect()}
    assert ckpt == {100: 100 / 1024 ** 2, 20: 20 / 1024 ** 2}
