"""Training-log monitoring as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.text import round_even, strip
from tuneprep.functions.logs import parsed_metrics, sample_blocks, trainer_row
from tuneprep.operators.ranking import blocked_lag, top_k_per_key

RECENT = 10


def parse_log(lines: DataFrame, tail_lines: int | None = None) -> DataFrame:
    """(experiment_id, ord, line) to metric rows; ``tail_lines`` looks at each log's end only."""
    if tail_lines is not None:
        lines = top_k_per_key(lines, ["experiment_id"], [F.col("ord").desc()], tail_lines)
    return parsed_metrics(lines.select("experiment_id", "ord", "line"))


def log_tail(lines: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` lines of each log."""
    return top_k_per_key(lines, ["experiment_id"], [F.col("ord").desc()], n)


def progress(metrics: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Snapshot per experiment: latest point, best loss, recent rate, remaining time.

    ``runs`` adds status, total_steps and total_epochs per experiment_id where known.
    """
    # One max_by per number keeps the aggregate hash-based; a struct would need a sort.
    fields = ["step", "epoch", "loss", "elapsed_seconds"]
    overall = metrics.groupBy("experiment_id").agg(
        *[F.max_by(f, "ord").alias(f) for f in fields], F.min("loss").alias("best_loss"),
        F.count(F.lit(1)).alias("points"),
    ).select("experiment_id", "best_loss", "points", F.struct(*fields).alias("last"))
    newest = top_k_per_key(metrics, ["experiment_id"], [F.col("ord").desc()], RECENT, rank="r")

    def at(rank: int):
        return F.max(F.when(F.col("r") == rank, F.struct("step", "elapsed_seconds")))

    edges = newest.groupBy("experiment_id").agg(
        at(1).alias("new"), F.coalesce(at(RECENT), at(2)).alias("old")
    )
    seconds = F.col("new.elapsed_seconds") - F.col("old.elapsed_seconds")
    rate = F.when(seconds > 0, (F.col("new.step") - F.col("old.step")) / seconds).otherwise(0.0)
    joined = overall.join(edges, "experiment_id")
    if runs is None:
        joined = joined.withColumns({
            "status": F.lit("running"), "total_steps": F.lit(0).cast("long"),
            "total_epochs": F.lit(0).cast("long"),
        })
    else:
        columns = ["experiment_id", "status", "total_steps", "total_epochs"]
        joined = joined.join(runs.select(*columns), "experiment_id", "left")
    total = F.coalesce(F.col("total_steps"), F.lit(0).cast("long"))
    left = (total - F.col("last.step")) / F.col("steps_per_second")
    return joined.withColumn("steps_per_second", rate).select(
        "experiment_id",
        F.coalesce("status", F.lit("running")).alias("status"),
        F.col("last.step").alias("current_step"),
        total.alias("total_steps"),
        F.col("last.epoch").cast("long").alias("current_epoch"),
        F.coalesce("total_epochs", F.lit(0).cast("long")).alias("total_epochs"),
        F.col("last.loss").alias("current_loss"),
        "best_loss",
        F.col("last.elapsed_seconds").alias("elapsed_seconds"),
        "steps_per_second",
        F.when((F.col("last.step") > 0) & (total > 0) & (F.col("steps_per_second") > 0), left)
        .otherwise(0.0).alias("estimated_remaining_seconds"),
        "points",
    )


def history_rows(metrics: DataFrame) -> DataFrame:
    """Display rows: epoch to 2 and loss to 4 decimals."""
    return metrics.select(
        "experiment_id", "ord", "step", round_even(F.col("epoch"), 2).alias("epoch"),
        round_even(F.col("loss"), 4).alias("loss"), F.col("learning_rate").alias("lr"),
        F.col("elapsed_seconds").alias("time"),
    )


def sample_outputs(logs: DataFrame, keep: int = 3,
                   limits: dict[str, int] | None = None) -> DataFrame:
    """(log_id, text) to the last prediction samples of each log, whole unless ``limits`` cuts them.

    The outer explode keeps the optimizer from adding a size filter that repeats the search.
    """
    samples = F.posexplode_outer(sample_blocks(F.col("text"), keep, limits)).alias("n", "s")
    return logs.select("log_id", samples).filter(F.col("n").isNotNull()).select(
        "log_id", "n", "s.*")


def run_summary(lines: DataFrame) -> DataFrame:
    """(run_id, ord, line) of trainer JSON rows to one summary per run.

    First and last loss come from rows with a loss; steps, epoch and time from the last row.
    """
    rows = lines.filter(strip(F.col("line")) != "").select(
        "run_id", "ord", trainer_row(F.col("line")).alias("t")
    )
    with_loss = F.when(F.col("t.loss").isNotNull(), F.col("ord"))
    # Numbers only, by a hash aggregate that reads each line once.
    numbers = rows.groupBy("run_id").agg(
        F.min_by("t.loss", with_loss).alias("initial_loss"),
        F.max_by("t.loss", with_loss).alias("final_loss"), F.max("ord").alias("ord"),
        F.max_by("t.current_steps", "ord").alias("steps"), F.max_by("t.epoch", "ord").alias("epochs"),
    )
    # The last line's text value: only the lines of these positions are parsed again.
    last = lines.select("run_id", "ord", "line").join(
        numbers.select("run_id", "ord"), ["run_id", "ord"], "left_semi").select(
        "run_id", trainer_row(F.col("line"))["elapsed_time"].alias("duration"))
    return numbers.join(last, "run_id").select(
        "run_id", "initial_loss", "final_loss", F.coalesce("duration", F.lit("?")).alias("duration"),
        F.coalesce("steps", F.lit(0).cast("long")).alias("steps"),
        F.coalesce("epochs", F.lit(0.0)).alias("epochs"),
    )


def run_report(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per run (run_id, name, params_b): losses, drop and a failed flag.

    The drop from a first loss of zero is infinite, as by IEEE division.
    """
    joined = runs.join(run_summary(lines), "run_id", "left")
    failed = F.coalesce(F.col("final_loss"), F.lit(0.0)) == 0
    drop = F.col("initial_loss") - F.col("final_loss")
    share = F.when(F.col("initial_loss") == 0, F.signum(drop) * float("inf")).otherwise(
        F.try_divide(drop, F.col("initial_loss")))
    return joined.select(
        "run_id", "name", "params_b", "initial_loss", "final_loss", "duration", "steps",
        F.when(~failed, share * 100).alias("drop_pct"), failed.alias("failed"),
    )


def loss_deltas(metrics: DataFrame, every: int | None = None, width: int = 65_536) -> DataFrame:
    """Loss change against the experiment's previous logged step.

    ``every`` keeps the steps that are multiples of it, plus each experiment's first and last.
    """
    rows = metrics.select("experiment_id", "step", "loss")
    if every:
        ends = rows.groupBy("experiment_id").agg(F.min("step").alias("_a"), F.max("step").alias("_b"))
        edge = F.explode(F.array("_a", "_b"))
        edges = ends.select("experiment_id", edge.alias("step")).distinct()
        on_grid = F.col("step") % every == 0
        inner = rows.filter(on_grid)
        outer = rows.filter(~on_grid).join(edges, ["experiment_id", "step"], "left_semi")
        rows = inner.unionByName(outer)
    lagged = blocked_lag(rows, "experiment_id", "step", "loss", "previous_loss", width)
    return lagged.withColumn("delta", F.col("loss") - F.col("previous_loss"))
