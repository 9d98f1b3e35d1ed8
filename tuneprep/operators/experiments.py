"""Experiment history: insert, update, delete, list, compare, statistics.

Tables are plain DataFrames in and out; the caller writes the result as a new table version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.operators.ranking import salted_join, top_k_per_key
from tuneprep.rules.terms import EXPERIMENT_DEFAULTS

# Names under which a configuration may carry the same setting.
CONFIG_ALIASES = {
    "num_epochs": ["num_epochs", "num_train_epochs"],
    "batch_size": ["batch_size", "per_device_train_batch_size"],
}
LIST_COLUMNS = [
    "id", "model_id", "model_name", "dataset_name", "finetuning_type", "status", "final_loss",
    "best_loss", "training_duration_seconds", "created_at", "updated_at",
]
COMPARE_COLUMNS = [
    "id", "model_name", "dataset_name", "finetuning_type", "final_loss", "best_loss",
    "training_duration_seconds", "lora_rank", "learning_rate", "num_epochs", "status",
]
# --- Fixed values: what an inserted experiment has where nothing is given ---
INSERT_DEFAULTS = {
    "model_name": "", "dataset_name": "", "dataset_size": 0, "finetuning_type": "lora",
    "preset": "standard", "config_json": "{}", "tags": "[]",
}
UPDATE_FIELDS = ["final_loss", "best_loss", "training_duration_seconds", "vram_peak_gb"]


def with_config(rows: DataFrame, config: str = "config_json") -> DataFrame:
    """Add the six stored settings and the chat template, with defaults for missing keys."""
    names = {k: CONFIG_ALIASES.get(k, [k]) for k in EXPERIMENT_DEFAULTS}
    kinds = {k: "double" if isinstance(v, float) else "bigint"
             for k, v in EXPERIMENT_DEFAULTS.items()}
    fields = [f"{a} {kinds[k]}" for k, aliases in names.items() for a in aliases]
    schema = ", ".join([*fields, "chat_template string"])
    kept = [c for c in rows.columns if c not in names and c != "chat_template"]
    return rows.withColumn(
        "_c", F.from_json(F.col(config), schema, {"mode": "PERMISSIVE"})
    ).select(
        *kept,
        *[F.coalesce(*[F.col(f"_c.{a}") for a in aliases],
                     F.lit(EXPERIMENT_DEFAULTS[k]).cast(kinds[k])).alias(k)
          for k, aliases in names.items()],
        F.coalesce(F.col("_c.chat_template"), F.lit("")).alias("chat_template"),
    )


def insert_experiments(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table after the insert, rejected rows); see ``accepted_experiments``."""
    accepted, rejected = accepted_experiments(base, new)
    return base.unionByName(accepted, allowMissingColumns=True), rejected


def accepted_experiments(base: DataFrame, new: DataFrame, freeze: Callable[[DataFrame], DataFrame] | None
                         = None) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rejected rows). An id already present, or repeated within the batch, is
    rejected; ``new.ord`` (unique) gives the batch order. Missing values of an accepted row take
    ``INSERT_DEFAULTS``; it was last updated when it was created. ``freeze`` may write the judged
    rows, which both results read, so that they are found once."""
    firsts = new.groupBy("id").agg(F.min("ord").alias("ord")).join(
        base.select("id"), "id", "left_anti").select("ord", F.lit(True).alias("_ok"))
    flagged = new.join(firsts, "ord", "left")
    flagged = freeze(flagged) if freeze else flagged
    rejected = flagged.filter(F.col("_ok").isNull()).drop("_ok")
    accepted = flagged.filter(F.col("_ok"))

    def given(name: str, default: object) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in new.columns else F.lit(default)

    created = F.unix_micros(F.current_timestamp()) / 1e6
    created = F.coalesce(F.col("created_at"), created) if "created_at" in new.columns else created
    filled = accepted.withColumns({k: given(k, v) for k, v in INSERT_DEFAULTS.items()}).withColumn(
        "created_at", created)
    prepared = with_config(filled).withColumns({
        "status": F.lit("initialized"), "updated_at": F.col("created_at")}).drop("ord", "_ok")
    return prepared, rejected


def update_experiments(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply updates (id, ord, status, updated_at and optional result fields).

    Several updates of one id fold into one by ``ord``: the last status, and the last non-null
    value of each result. Unknown ids change nothing.
    """
    fields = [f for f in UPDATE_FIELDS if f in updates.columns]

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ord"))).alias(f"_{name}")

    # Numbers are folded by a hash aggregate; the status text is fetched from the last update.
    numbers = updates.groupBy("id").agg(
        F.max("ord").alias("ord"), F.max_by("updated_at", "ord").alias("_updated_at"),
        *[last(f) for f in fields],
    )
    folded = numbers.join(updates.select("id", "ord", F.col("status").alias("_status")),
                          ["id", "ord"]).drop("ord")
    changed = [*fields, "status", "updated_at"]
    return base.join(folded, "id", "left").select(*[
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
        for c in base.columns
    ])


def experiment_details(experiments: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Experiments with their checkpoints, one row per checkpoint (nulls when there is none).

    ``config`` (a map) and ``tags`` (a list) are decoded; what cannot be read is empty.
    Kept flat because an experiment's checkpoint list has no bound; sort by (id, step desc).
    """
    listed = checkpoints.select(
        F.col("experiment_id").alias("id"), "step", "path", "size_mb", F.col("loss").alias("ckpt_loss")
    )
    decoded = experiments.withColumn("config", F.coalesce(
        F.from_json("config_json", "map<string,string>"), F.create_map().cast("map<string,string>")
    )).drop("config_json")
    if "tags" in experiments.columns:
        decoded = decoded.withColumn("tags", F.coalesce(
            F.from_json("tags", "array<string>"), F.array().cast("array<string>")))
    experiments = decoded
    joined = salted_join(listed, experiments, "id", ["path"])
    bare = experiments.join(listed.select("id").distinct(), "id", "left_anti")
    return joined.unionByName(bare, allowMissingColumns=True)


def list_experiments(experiments: DataFrame, status: str | None = None, limit: int = 50,
                     offset: int = 0) -> DataFrame:
    """Newest first, with an optional status filter and paging."""
    rows = experiments.filter(F.col("status") == status) if status else experiments
    return (
        rows.select(*LIST_COLUMNS)
        .orderBy(F.col("created_at").desc(), "id")
        .offset(offset)
        .limit(limit)
    )


def delete_experiments(ids: DataFrame, experiments: DataFrame, checkpoints: DataFrame,
                       metrics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the given ids."""
    doomed = ids.select("id").distinct()
    owners = doomed.withColumnRenamed("id", "experiment_id")
    return (
        experiments.join(doomed, "id", "left_anti"),
        salted_join(checkpoints, owners, "experiment_id", ["path"], "left_anti"),
        salted_join(metrics, owners, "experiment_id", ["step"], "left_anti"),
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows to a Parquet table."""
    metrics.write.mode("append").parquet(path)


def metric_history(metrics: DataFrame, limit: int = 500) -> DataFrame:
    """First ``limit`` metric rows of each experiment in step order."""
    return top_k_per_key(metrics, ["experiment_id"], [F.col("step"), F.col("ord")], limit)


def compare_experiments(requested: DataFrame, group: str, order: str = "req_ord") -> DataFrame:
    """Per comparison group: lowest final loss and shortest run; zero and null do not count.

    Ties go to the experiment requested first.
    """

    def best(value: str, name: str) -> DataFrame:
        usable = requested.filter(F.coalesce(F.col(value), F.lit(0.0)) != 0)
        first = top_k_per_key(usable.select(group, value, order, "id"), [group],
                              [F.col(value), F.col(order)], 1)
        return first.select(F.col(group).alias("_g"), F.col("id").alias(name))

    out = requested.groupBy(group).agg(F.count(F.lit(1)).alias("experiments"))
    for value, name in (("final_loss", "best_loss_exp"),
                        ("training_duration_seconds", "fastest_exp")):
        out = out.join(best(value, name), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    return out


def compared_rows(requested: DataFrame, experiments: DataFrame) -> DataFrame:
    """The compared columns of the requested ids (id, req_ord); unknown ids are dropped."""
    stored = with_config(experiments) if "lora_rank" not in experiments.columns else experiments
    return requested.select("id", "req_ord").join(stored.select(*COMPARE_COLUMNS), "id").select(
        "req_ord", *COMPARE_COLUMNS)


def statistics(experiments: DataFrame) -> DataFrame:
    """Counts, training hours and average final loss over the whole history."""
    return experiments.agg(
        F.count(F.lit(1)).alias("total_experiments"),
        F.count(F.when(F.col("status") == "completed", F.lit(1))).alias("completed_experiments"),
        F.count(F.when(F.col("status") == "failed", F.lit(1))).alias("failed_experiments"),
        (F.coalesce(F.sum("training_duration_seconds"), F.lit(0.0)) / 3600.0)
        .alias("total_training_hours"),
        F.coalesce(F.avg("final_loss"), F.lit(0.0)).alias("avg_loss"),
    )


def most_used(experiments: DataFrame, column: str) -> DataFrame:
    """Most frequent value; ties go to the smaller one."""
    return (
        experiments.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), column)
        .limit(1)
    )
