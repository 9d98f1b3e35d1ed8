import time

import pytest
from pyspark.sql import functions as F

from tuneprep.operators import experiments as E
from tuneprep.operators import monitor as MO
from tuneprep.streaming import progress as SP

LINES = [
    '{"step": 10, "epoch": 0.1, "loss": 2.5, "learning_rate": 0.0002, "elapsed_seconds": 10}',
    '{"step": 20, "epoch": 0.2, "loss": 2.3, "learning_rate": 0.0002, "elapsed_seconds": 20}',
    "noise", '{"step": 25, "eval": 1}', '{"step": 27, "loss": ', "",
    "{'loss': 1.9, 'grad_norm': 0.4, 'learning_rate': 1e-05, 'epoch': 0.5}",
    '{"step": 30, "epoch": 0.3, "loss": 2.1, "learning_rate": 0.0002, "elapsed_seconds": 40}',
]


def log(spark, lines=LINES, name="e"):
    return spark.createDataFrame([(name, i, t) for i, t in enumerate(lines)],
                                 "experiment_id string, ord bigint, line string")


def experiments(spark):
    return spark.createDataFrame(
        [("a", "m1", "M1", "d1", "lora", "completed", 1.5, 1.3, 3600.0, 1.0, 1.0, "{}"),
         ("b", "m1", "M2", "d2", "qlora", "failed", 1.8, None, 0.0, 2.0, 2.0, "{}")],
        "id string, model_id string, model_name string, dataset_name string, "
        "finetuning_type string, status string, final_loss double, best_loss double, "
        "training_duration_seconds double, created_at double, updated_at double, config_json string")


def test_parse(spark):
    got = MO.parse_log(log(spark)).orderBy("ord").collect()
    assert [(r.ord, r.step, r.loss, r.style) for r in got] == [
        (0, 10, 2.5, "json"), (1, 20, 2.3, "json"), (6, 0, 1.9, "text"), (7, 30, 2.1, "json")]
    assert got[2].learning_rate == 1e-05 and got[2].epoch == 0.5
    assert MO.parse_log(log(spark), tail_lines=2).count() == 2


def test_progress(spark):
    row = MO.progress(MO.parse_log(log(spark, [LINES[0], LINES[1], LINES[7]])), spark.createDataFrame(
        [("e", "running", 100, 3)],
        "experiment_id string, status string, total_steps bigint, total_epochs bigint")).first()
    assert (row.current_step, row.best_loss, row.points) == (30, 2.1, 3)
    assert row.steps_per_second == (30 - 20) / (40 - 20)
    assert row.estimated_remaining_seconds == (100 - 30) / 0.5


def test_recent_rate_uses_ten_points(spark):
    lines = ['{"step": %d, "loss": 1.0, "elapsed_seconds": %d}' % (i * i, i) for i in range(1, 15)]
    row = MO.progress(MO.parse_log(log(spark, lines))).first()
    assert row.steps_per_second == (14 ** 2 - 5 ** 2) / 9


def test_store(spark):
    base = experiments(spark)
    new = spark.createDataFrame(
        [(0, "a", "m", '{}'), (1, "c", "m", '{"num_epochs": 9}'), (2, "c", "m2", '{}')],
        "ord bigint, id string, model_id string, config_json string")
    table, rejected = E.insert_experiments(base, new)
    assert {r.id for r in table.collect()} == {"a", "b", "c"}
    assert [r.num_epochs for r in table.filter("id = 'c'").collect()] == [9]
    assert sorted(r.ord for r in rejected.collect()) == [0, 2]
    updates = spark.createDataFrame(
        [("a", 0, "running", 5.0, 0.9), ("a", 1, "completed", 6.0, None), ("zz", 2, "x", 1.0, 1.0)],
        "id string, ord bigint, status string, updated_at double, final_loss double")
    a = E.update_experiments(base, updates).filter("id = 'a'").first()
    assert (a.status, a.updated_at, a.final_loss, a.best_loss) == ("completed", 6.0, 0.9, 1.3)
    assert E.update_experiments(base, updates).count() == 2
    assert [r.id for r in E.list_experiments(base).collect()] == ["b", "a"]
    assert [r.id for r in E.list_experiments(base, limit=1, offset=1).collect()] == ["a"]
    stats = E.statistics(base).first()
    assert (stats.total_experiments, stats.completed_experiments, stats.failed_experiments,
            stats.total_training_hours) == (2, 1, 1, 1.0)
    assert E.most_used(base, "model_id").first().model_id == "m1"


def test_compare(spark):
    rows = experiments(spark).withColumn("g", F.lit(1)).withColumn("req_ord", F.lit(0))
    got = E.compare_experiments(rows, "g").first()
    assert (got.best_loss_exp, got.fastest_exp) == ("a", "a")


def test_details_and_delete(spark):
    ckpts = spark.createDataFrame([("a", 10, "p1", 1.0, 2.0), ("a", 20, "p2", 1.0, 1.0)],
                                  "experiment_id string, step bigint, path string, size_mb double, loss double")
    got = E.experiment_details(experiments(spark), ckpts).orderBy("id", F.col("step").desc()).collect()
    assert [(r.id, r.step) for r in got] == [("a", 20), ("a", 10), ("b", None)]
    metrics = spark.createDataFrame([("a", 1, 0, 1.0), ("b", 1, 1, 1.0)],
                                    "experiment_id string, step bigint, ord bigint, loss double")
    ids = spark.createDataFrame([("a",)], "id string")
    left = E.delete_experiments(ids, experiments(spark), ckpts, metrics)
    assert [t.count() for t in left] == [1, 0, 1]


def test_metrics_append_and_history(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 20, 1, 2.3), ("a", 10, 0, 2.5)],
                                    "experiment_id string, step bigint, ord bigint, loss double")
    E.append_metrics(metrics, str(tmp_path / "m"))
    E.append_metrics(metrics.withColumn("step", F.col("step") + 100), str(tmp_path / "m"))
    table = spark.read.parquet(str(tmp_path / "m"))
    assert table.count() == 4
    assert sorted(r.step for r in E.metric_history(table, 3).collect()) == [10, 20, 110]


def test_samples(spark):
    block = 'predict_%d {\n"input": "q%d",\n"predict": "p", x "label": "l%d"}\n'
    text = "start\n" + "".join(block % (i, i, i) for i in range(5)) + 'predict_9 "input": "cut'
    got = MO.sample_outputs(spark.createDataFrame([(1, text), (2, "none")],
                                                  "log_id bigint, text string")).collect()
    assert [(r.log_id, r.n, r.step, r.input, r.label) for r in got] == [
        (1, 0, "2", "q2", "l2"), (1, 1, "3", "q3", "l3"), (1, 2, "4", "q4", "l4")]


def test_run_report(spark):
    lines = spark.createDataFrame(
        [("r", 0, '{"loss": 2.0, "current_steps": 1}'), ("r", 1, ""),
         ("r", 2, '{"loss": 1.0, "current_steps": 2, "elapsed_time": "0:10", "epoch": 0.5}'),
         ("r", 3, '{"current_steps": 3, "elapsed_time": "0:20", "epoch": 1.0}')],
        "run_id string, ord bigint, line string")
    runs = spark.createDataFrame([("r", "R", 1.5), ("s", "S", 7.0)],
                                 "run_id string, name string, params_b double")
    got = {r.run_id: r for r in MO.run_report(runs, lines).collect()}
    assert (got["r"].initial_loss, got["r"].final_loss, got["r"].steps, got["r"].duration,
            got["r"].drop_pct) == (2.0, 1.0, 3, "0:20", 50.0)
    assert got["s"].failed and not got["r"].failed


def test_run_report_first_loss_zero(spark):
    losses = {"up": ("0.00", "5.0"), "down": ("0.00", "-2.0"), "zero": ("0.00", "0.00"), "r": ("2.0", "1.0")}
    lines = spark.createDataFrame(
        [(run, i, '{"loss": %s}' % x) for run, both in losses.items() for i, x in enumerate(both)],
        "run_id string, ord bigint, line string")
    runs = spark.createDataFrame([(run, "R", 1.5) for run in losses],
                                 "run_id string, name string, params_b double")
    got = {r.run_id: (r.drop_pct, r.failed) for r in MO.run_report(runs, lines).collect()}
    infinite = float("inf")
    assert got == {"up": (-infinite, False), "down": (infinite, False), "zero": (None, True), "r": (50.0, False)}


def test_loss_deltas(spark):
    rows = [("a", s, 2.0 - s / 100) for s in (1, 7, 20, 33, 40, 47)]
    metrics = spark.createDataFrame(rows, "experiment_id string, step bigint, loss double")
    got = MO.loss_deltas(metrics, every=20, width=10).orderBy("step").collect()
    assert [r.step for r in got] == [1, 20, 40, 47]
    assert [None if r.delta is None else round(r.delta, 2) for r in got] == [None, -0.19, -0.2, -0.07]


@pytest.mark.parametrize("points", [1, 9, 10, 40])
def test_stream_equals_batch(spark, tmp_path, points):
    lines = [('{"step": %d, "epoch": 1.5, "loss": %f, "elapsed_seconds": %d}'
              % (i * 3, 1 + (i * 7 % 5), i * i)) for i in range(points)] + ["noise"]
    both = log(spark, lines).unionByName(log(spark, LINES, "other"))
    for part in range(3):
        both.filter(F.col("ord") % 3 == part).write.parquet(str(tmp_path / "in" / f"p{part}"))
        time.sleep(0.01)
    stream = (spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 2)
              .parquet(str(tmp_path / "in" / "*")))
    SP.write_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "c"),
                       availableNow=True).awaitTermination()
    got = SP.latest_snapshots(spark, str(tmp_path / "out"))
    batch = MO.progress(MO.parse_log(both)).select(*got.columns)
    assert sorted(got.collect()) == sorted(batch.collect())


def test_stream_follows_new_segments(spark, tmp_path):
    folder = tmp_path / "logs" / "e1"
    folder.mkdir(parents=True)
    text = "{{'loss': {}, 'learning_rate': 0.1, 'epoch': 1.0}}\n"

    def follow():
        SP.write_snapshots(SP.log_stream(spark, str(tmp_path / "logs" / "*")), str(tmp_path / "out"),
                           str(tmp_path / "c"), availableNow=True).awaitTermination()
        return SP.latest_snapshots(spark, str(tmp_path / "out")).collect()

    (folder / "b.log").write_text('{"step": 7, "epoch": 1, "loss": 0.5, "elapsed_seconds": 9}\n'
                                  + text.format(0.75))
    assert [(r.current_loss, r.best_loss, r.points) for r in follow()] == [(0.75, 0.5, 2)]
    for i in range(3):
        time.sleep(0.02)
        (folder / f"a{i}.log").write_text(text.format(0.25 * (i + 1)) * 20)
        assert [(r.current_loss, r.best_loss, r.points) for r in follow()] == [
            (0.25 * (i + 1), 0.25, 22 + 20 * i)]


def test_metric_stream(spark, tmp_path):
    (tmp_path / "logs" / "e1").mkdir(parents=True)
    (tmp_path / "logs" / "e1" / "training.log").write_text("\n".join(LINES))
    lines = SP.log_stream(spark, str(tmp_path / "logs" / "*"))
    SP.write_metrics(lines, str(tmp_path / "m"), str(tmp_path / "c"),
                     availableNow=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "m"))
    assert {r.experiment_id for r in got.collect()} == {"e1"} and got.count() == 4
