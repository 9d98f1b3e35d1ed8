"""The stored history: only touched buckets change, repeats change nothing."""

import pytest

from tuneprep.sources.store import BUCKET, ExperimentStore

TABLES = ("experiments", "checkpoints", "metrics")


@pytest.fixture
def store(spark, tmp_path):
    out = ExperimentStore(spark, str(tmp_path / "store"), buckets=64)
    out.create(
        experiments=spark.createDataFrame(
            [(f"e{i}", "m", "running", None, 1.0, 1.0) for i in range(500)] + [(None, "m", "x", 0.0, 1.0, 1.0)],
            "id string, model_id string, status string, final_loss double, created_at double, updated_at double"),
        checkpoints=spark.createDataFrame([(f"e{i}", 10, f"p{i}") for i in range(0, 500, 5)],
                                          "experiment_id string, step bigint, path string"),
        metrics=spark.createDataFrame([(f"e{i % 50}", i, i) for i in range(1000)],
                                      "experiment_id string, step bigint, ord bigint"))
    return out


def files(store, tmp_path):
    """Names of the data files by table and bucket; Spark gives every file it writes a new name."""
    return {name: {d.name: {f.name for f in d.glob("*.parquet")}
                   for d in (tmp_path / "store" / name).glob(f"{BUCKET}=*")} for name in TABLES}


def changed(before, after):
    return {name: {b for b in before[name] | after[name] if before[name].get(b) != after[name].get(b)}
            for name in TABLES}


def rows(store, name):
    return sorted(store.table(name).collect(), key=repr)


def test_update_rewrites_touched_buckets(spark, store, tmp_path):
    updates = spark.createDataFrame(
        [(f"e{i}", 0, "done", 2.0, float(i)) for i in range(10)] + [("unknown", 0, "x", 2.0, 1.0), (None, 1, "y", 2.0, 1.0)],
        "id string, ord bigint, status string, updated_at double, final_loss double")
    before = files(store, tmp_path)
    store.update(updates)
    moved = changed(before, files(store, tmp_path))
    assert 0 < len(moved["experiments"]) <= 11 and not moved["checkpoints"] and not moved["metrics"]
    got = rows(store, "experiments")
    assert len(got) == 501 and sum(r["status"] == "done" for r in got) == 10
    store.update(updates)
    assert rows(store, "experiments") == got
    store.update(updates.limit(0))
    assert rows(store, "experiments") == got


def test_insert_and_repeat(spark, store, tmp_path):
    new = spark.createDataFrame([(0, "e3", "m", "{}"), (1, "n1", "m", "{}"), (2, "n1", "m2", "{}"), (3, "n2", "m", "{}")],
                                "ord bigint, id string, model_id string, config_json string")
    before = files(store, tmp_path)
    assert sorted(r["ord"] for r in store.insert(new).collect()) == [0, 2]
    assert len(changed(before, files(store, tmp_path))["experiments"]) <= 3
    assert {r["id"] for r in store.table("experiments").where("status = 'initialized'").collect()} == {"n1", "n2"}
    assert sorted(r["ord"] for r in store.insert(new).collect()) == [0, 1, 2, 3]
    assert store.table("experiments").count() == 503


def test_delete_cascades_and_empties(spark, store, tmp_path):
    ids = spark.createDataFrame([("e5",), ("e7",), ("nobody",)], "id string")
    before = files(store, tmp_path)
    store.delete(ids)
    moved = changed(before, files(store, tmp_path))
    assert all(len(b) <= 3 for b in moved.values())
    assert [store.table(n).count() for n in TABLES] == [499, 99, 960]
    store.delete(ids)
    assert [store.table(n).count() for n in TABLES] == [499, 99, 960]
    store.append("metrics", spark.createDataFrame([("e5", 1, 1)], "experiment_id string, step bigint, ord bigint"))
    assert store.table("metrics").where("experiment_id = 'e5'").count() == 1
    store.delete(store.table("experiments").select("id"))
    # The null id is left, and the metric that came for a removed experiment.
    assert [store.table(n).count() for n in TABLES] == [1, 0, 1]


def test_delete_and_insert_compute_their_rows_once(spark, store):
    """Rows that every operation reads: a table's once for its new content, requests once to judge them."""
    def counted(rows, name, seen):
        def count(batches):
            for batch in batches:
                seen[name].add(batch.num_rows)
                yield batch
        return rows.mapInArrow(count, rows.schema)

    class Watched(ExperimentStore):
        def table(self, name, touched=None):
            rows = super().table(name, touched)
            return rows if touched is None else counted(rows, name, seen)

    seen = {name: spark.sparkContext.accumulator(0) for name in (*TABLES, "new")}
    watched = Watched(spark, store.path, store.buckets)
    watched.delete(spark.createDataFrame([(f"e{i}",) for i in range(500)], "id string"))
    # One count for frequent keys, one pass for the new content.
    assert {name: seen[name].value for name in TABLES} == {
        "experiments": 500 + len(rows(store, "experiments")), "checkpoints": 200, "metrics": 2000}
    assert [store.table(n).count() for n in TABLES] == [1, 0, 0]


def test_rejected_rows_are_judged_once(spark, store):
    new = spark.createDataFrame([(0, "e3", "m"), (1, "n1", "m"), (2, "n1", "m2"), (None, "n2", "m")],
                                "ord bigint, id string, model_id string")
    rejected = store.insert(new)
    assert sorted((r["ord"] is None, r["ord"]) for r in rejected.collect()) == [(False, 0), (False, 2), (True, None)]
    assert all("judged" in f for f in rejected.inputFiles())


def test_insert_leaves_what_is_there(spark, store, tmp_path):
    before = files(store, tmp_path)["experiments"]
    store.insert(spark.range(2000).selectExpr("id AS ord", "concat('n', id) AS id", "'m' AS model_id"))
    after = files(store, tmp_path)["experiments"]
    assert all(names < after[bucket] for bucket, names in before.items())
    assert store.table("experiments").count() == 2501


def test_frequent_keys_are_broadcast(spark):
    """The list of frequent keys is broadcast, so that the many rows are dealt out once."""
    from tuneprep.operators.ranking import salted_join
    many = spark.range(1000).selectExpr("id % 7 AS k", "id AS ord")
    one = spark.range(5).selectExpr("id AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(many, one, "k", ["ord"], "left_anti", hot_rows=100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and joined.count() == 285
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
