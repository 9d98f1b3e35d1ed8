"""Queries over the experiment history and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.operators import experiments as E
from tuneprep.operators import monitor as MO
from tuneprep.operators import samples as S
from tuneprep.plans.registry import query
from tuneprep.plans.tables import Tables
from tuneprep.rules.terms import SAMPLE_LIMITS, DICT_LINE, SAMPLE_BLOCK
from tuneprep.session import scratch_path
from tuneprep.sources.growing import write_logs
from tuneprep.sources.store import ExperimentStore
from tuneprep.streaming import progress as SP

# --- Store -----------------------------------------------------------------------------------


def _new_experiments(t: Tables) -> DataFrame:
    """Insert requests, many per id: one per event, with ids that partly exist."""
    key = F.col("event_id")
    return t.raw("events").select(
        key.alias("ord"),
        F.concat(F.lit("exp_"), (F.col("user_id") * 200).cast("string")).alias("id"),
        F.concat(F.lit("model_"), (key % 7).cast("string")).alias("model_id"),
        F.concat(F.lit('{"lora_rank": '), (key % 64).cast("string"), F.lit("}")).alias("config_json"),
        key.cast("double").alias("created_at"),
    )


@query("""
WITH new AS (SELECT event_id AS ord, 'exp_' || (user_id * 200) AS id,
                    'model_' || (event_id % 7) AS model_id, event_id % 64 AS lora_rank,
                    CAST(event_id AS DOUBLE) AS created_at FROM events),
good AS (SELECT * FROM new WHERE id NOT IN (SELECT id FROM v_experiments)
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)
SELECT id, model_id, model_name, dataset_name, dataset_size, finetuning_type, preset, status,
       NULL::BIGINT AS lora_rank, created_at, updated_at, tags FROM v_experiments
UNION ALL SELECT id, model_id, '', '', 0, 'lora', 'standard', 'initialized', lora_rank, created_at,
       created_at, '[]' FROM good""")
def exp_insert(t: Tables) -> DataFrame:
    table, _ = E.insert_experiments(t.experiments(), _new_experiments(t))
    return table.select("id", "model_id", "model_name", "dataset_name", "dataset_size",
                        "finetuning_type", "preset", "status", "lora_rank", "created_at",
                        "updated_at", "tags")


@query("""
WITH new AS (SELECT event_id AS ord, 'exp_' || (user_id * 200) AS id FROM events),
good AS (SELECT * FROM new WHERE id NOT IN (SELECT id FROM v_experiments)
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)
SELECT id, ord FROM new WHERE ord NOT IN (SELECT ord FROM good)""")
def exp_insert_rejected(t: Tables) -> DataFrame:
    _, rejected = E.insert_experiments(t.experiments(), _new_experiments(t))
    return rejected.select("id", "ord")


def _updates(t: Tables) -> DataFrame:
    """Update requests, many per id: one per event."""
    key = F.col("event_id")
    return t.raw("events").select(
        F.concat(F.lit("exp_"), F.col("user_id").cast("string")).alias("id"), key.alias("ord"),
        F.col("event_type").alias("status"), key.cast("double").alias("updated_at"),
        F.when(key % 3 == 0, F.col("value")).alias("final_loss"),
        F.when(key % 5 == 0, F.col("value") / 2.0).alias("vram_peak_gb"),
    )


@query("""
WITH u AS (SELECT 'exp_' || user_id AS id, event_id AS ord, event_type AS status,
                  CAST(event_id AS DOUBLE) AS updated_at,
                  CASE WHEN event_id % 3 = 0 THEN value END AS final_loss,
                  CASE WHEN event_id % 5 = 0 THEN value / CAST(2 AS DOUBLE) END AS vram_peak_gb
           FROM events),
f AS (SELECT id, arg_max(status, ord) AS status, arg_max(updated_at, ord) AS updated_at,
             arg_max(final_loss, ord) FILTER (final_loss IS NOT NULL) AS final_loss,
             arg_max(vram_peak_gb, ord) FILTER (vram_peak_gb IS NOT NULL) AS vram_peak_gb
      FROM u GROUP BY id)
SELECT e.id, coalesce(f.status, e.status) AS status,
       coalesce(f.final_loss, e.final_loss) AS final_loss, e.best_loss,
       coalesce(f.vram_peak_gb, e.vram_peak_gb) AS vram_peak_gb,
       coalesce(f.updated_at, e.updated_at) AS updated_at
FROM v_experiments e LEFT JOIN f ON f.id = e.id""")
def exp_update(t: Tables) -> DataFrame:
    updates = _updates(t)
    return E.update_experiments(t.experiments(), updates).select(
        "id", "status", "final_loss", "best_loss", "vram_peak_gb", "updated_at"
    )


@query("""
SELECT e.id, e.status, json_extract_string(e.config_json, '$.lora_alpha') AS lora_alpha,
       json_extract_string(e.config_json, '$.chat_template') AS chat_template,
       array_to_string(CAST(e.tags AS JSON)::VARCHAR[], '+') AS tags,
       c.step, c.path, c.size_mb, c.loss AS ckpt_loss
FROM v_experiments e LEFT JOIN v_checkpoints c ON c.experiment_id = e.id""")
def exp_detail(t: Tables) -> DataFrame:
    details = E.experiment_details(t.experiments(), t.checkpoints())
    return details.select(
        "id", "status", F.try_element_at("config", F.lit("lora_alpha")).alias("lora_alpha"),
        F.try_element_at("config", F.lit("chat_template")).alias("chat_template"),
        F.array_join("tags", "+").alias("tags"), "step", "path", "size_mb", "ckpt_loss")


@query(f"""
WITH new AS (SELECT event_id AS ord, 'exp_' || (user_id * 200) AS id FROM events),
added AS (SELECT id, arg_min('model_' || (ord % 7), ord) AS model_id FROM new
          WHERE id NOT IN (SELECT id FROM v_experiments) GROUP BY id),
latest AS (SELECT 'exp_' || user_id AS id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1),
rows AS (SELECT e.id, model_id, coalesce(u.status, e.status) AS status
         FROM (SELECT id, model_id, status FROM v_experiments
               UNION ALL SELECT id, model_id, 'initialized' FROM added) e
         LEFT JOIN latest u ON u.id = e.id),
gone AS (SELECT id FROM rows WHERE status = 'failed' OR status = 'click')
SELECT 'experiments' AS tbl, id, NULL::BIGINT AS step, model_id || status AS info FROM rows
WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'checkpoints', experiment_id, step, path FROM v_checkpoints
WHERE experiment_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'metrics', experiment_id, step, CAST(ord AS VARCHAR) FROM v_metrics
WHERE experiment_id NOT IN (SELECT id FROM gone)""")
def exp_store(t: Tables) -> DataFrame:
    """Insert, update and delete in a stored history, as read again afterwards."""
    store = ExperimentStore(t.spark, scratch_path(t.spark, "store"), buckets=16)
    store.create(experiments=t.experiments(), checkpoints=t.checkpoints(), metrics=t.metrics())
    store.insert(_new_experiments(t))
    store.update(_updates(t))
    store.delete(store.table("experiments").where("status IN ('failed', 'click')").select("id"))
    none, owner = F.lit(None).cast("bigint"), F.col("experiment_id").alias("id")
    return (
        store.table("experiments").select(F.lit("experiments").alias("tbl"), "id", none.alias("step"),
                                          F.concat("model_id", "status").alias("info"))
        .union(store.table("checkpoints").select(F.lit("checkpoints"), owner, "step", "path"))
        .union(store.table("metrics").select(F.lit("metrics"), owner, "step", F.col("ord").cast("string")))
    )


@query(f"""
SELECT {", ".join(E.LIST_COLUMNS)} FROM v_experiments WHERE status = 'completed'
ORDER BY created_at DESC, id LIMIT 50 OFFSET 10""")
def exp_list(t: Tables) -> DataFrame:
    return E.list_experiments(t.experiments(), "completed", limit=50, offset=10)


_DOOMED = "SELECT id FROM v_experiments WHERE status = 'failed'"


@query(f"""
SELECT 'experiments' AS tbl, id, NULL::BIGINT AS step, status AS info FROM v_experiments
WHERE id NOT IN ({_DOOMED})
UNION ALL SELECT 'checkpoints', experiment_id, step, path FROM v_checkpoints
WHERE experiment_id NOT IN ({_DOOMED})
UNION ALL SELECT 'metrics', experiment_id, step, CAST(ord AS VARCHAR) FROM v_metrics
WHERE experiment_id NOT IN ({_DOOMED})""")
def exp_delete(t: Tables) -> DataFrame:
    experiments = t.experiments()
    ids = experiments.filter(F.col("status") == "failed").select("id")
    kept, checkpoints, metrics = E.delete_experiments(ids, experiments, t.checkpoints(), t.metrics())
    none = F.lit(None).cast("bigint")
    owner = F.col("experiment_id").alias("id")
    return (
        kept.select(F.lit("experiments").alias("tbl"), "id", none.alias("step"),
                    F.col("status").alias("info"))
        .union(checkpoints.select(F.lit("checkpoints"), owner, "step", "path"))
        .union(metrics.select(F.lit("metrics"), owner, "step", F.col("ord").cast("string")))
    )


@query("""
SELECT experiment_id, ord, step, epoch, loss, learning_rate, elapsed_seconds FROM v_metrics
QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY step, ord) <= 50""")
def metric_history(t: Tables) -> DataFrame:
    return E.metric_history(t.metrics(), 50).drop("grad_norm")


@query("""
SELECT dataset_name, count(*) AS experiments,
       arg_min(id, [final_loss, r]) FILTER (coalesce(final_loss, 0) <> 0) AS best_loss_exp,
       arg_min(id, [training_duration_seconds, r])
           FILTER (training_duration_seconds <> 0) AS fastest_exp
FROM (SELECT *, CAST(replace(id, 'exp_', '') AS DOUBLE) AS r FROM v_experiments)
GROUP BY dataset_name""")
def exp_compare(t: Tables) -> DataFrame:
    requested = t.experiments().withColumn(
        "req_ord", F.substring_index("id", "_", -1).cast("long")
    )
    return E.compare_experiments(requested, "dataset_name")


@query(f"""
WITH cfg AS (SELECT *, CAST(replace(id, 'exp_', '') AS BIGINT) AS k FROM v_experiments)
SELECT c_custkey AS req_ord, id, model_name, dataset_name, finetuning_type, final_loss, best_loss,
       training_duration_seconds, CASE WHEN k % 4 = 1 THEN k % 64 ELSE 16 END AS lora_rank,
       CAST(0.0002 AS DOUBLE) AS learning_rate,
       CASE WHEN k % 4 = 1 THEN 7 WHEN k % 4 = 2 THEN k % 9 ELSE 3 END AS num_epochs, status
FROM customer JOIN cfg ON id = 'exp_' || c_custkey""")
def exp_compare_rows(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    requested = t.raw("customer").select(
        F.concat(F.lit("exp_"), key.cast("string")).alias("id"), key.alias("req_ord"))
    return E.compared_rows(requested, t.experiments())


@query("""
SELECT count(*) AS total_experiments,
       count(*) FILTER (status = 'completed') AS completed_experiments,
       count(*) FILTER (status = 'failed') AS failed_experiments,
       round(coalesce(sum(training_duration_seconds), 0) / 3600, 6) AS total_training_hours,
       round(coalesce(avg(final_loss), 0), 6) AS avg_loss
FROM v_experiments""")
def exp_stats(t: Tables) -> DataFrame:
    stats = E.statistics(t.experiments())
    return stats.withColumns({
        "total_training_hours": F.round("total_training_hours", 6),
        "avg_loss": F.round("avg_loss", 6),
    })


@query("""
(SELECT 'model_id' AS kind, model_id AS name, count(*) AS n FROM v_experiments
 GROUP BY model_id ORDER BY n DESC, model_id LIMIT 1)
UNION ALL
(SELECT 'dataset_name', dataset_name, count(*) AS n FROM v_experiments
 GROUP BY dataset_name ORDER BY n DESC, dataset_name LIMIT 1)""")
def most_used(t: Tables) -> DataFrame:
    out = None
    for column in ("model_id", "dataset_name"):
        row = E.most_used(t.experiments(), column).select(
            F.lit(column).alias("kind"), F.col(column).alias("name"), "n"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("""
WITH c AS (SELECT id, CAST(replace(id, 'exp_', '') AS BIGINT) AS k FROM v_experiments)
SELECT id, CASE WHEN k % 4 = 1 THEN k % 64 ELSE 16 END AS lora_rank,
       CASE WHEN k % 4 = 3 THEN 64 ELSE 32 END AS lora_alpha,
       CAST(0.0002 AS DOUBLE) AS learning_rate,
       CASE WHEN k % 4 = 1 THEN 7 WHEN k % 4 = 2 THEN k % 9 ELSE 3 END AS num_epochs,
       CASE WHEN k % 4 = 2 THEN 2 ELSE 4 END AS batch_size,
       CASE WHEN k % 4 = 3 THEN 512 ELSE 2048 END AS max_seq_length,
       CASE WHEN k % 4 = 3 THEN 'chatml' ELSE '' END AS chat_template
FROM c""", longs=("lora_alpha", "batch_size", "max_seq_length"))
def exp_config(t: Tables) -> DataFrame:
    return E.with_config(t.experiments().select("id", "config_json")).drop("config_json")


# --- Monitoring ------------------------------------------------------------------------------


def _json_number(name: str) -> str:
    return f"TRY_CAST(json_extract_string(j, '$.{name}') AS DOUBLE)"


def _parsed_sql(lines: str) -> str:
    pattern = DICT_LINE.replace("'", "''")
    return f"""
raw AS (SELECT experiment_id, ord, trim(line) AS line,
               CASE WHEN json_valid(trim(line)) THEN trim(line) END AS j FROM {lines}),
fields AS (SELECT *, {_json_number("loss")} AS jl,
                  TRY_CAST(regexp_extract(line, '{pattern}', 1) AS DOUBLE) AS tl,
                  TRY_CAST(regexp_extract(line, '{pattern}', 2) AS DOUBLE) AS tr,
                  TRY_CAST(regexp_extract(line, '{pattern}', 3) AS DOUBLE) AS te FROM raw),
parsed AS (SELECT experiment_id, ord,
       CASE WHEN jl IS NOT NULL THEN CAST(coalesce({_json_number("step")}, 0) AS BIGINT) ELSE 0 END
           AS step,
       CASE WHEN jl IS NOT NULL THEN coalesce({_json_number("epoch")}, 0) ELSE te END AS epoch,
       coalesce(jl, tl) AS loss,
       CASE WHEN jl IS NOT NULL THEN coalesce({_json_number("learning_rate")}, 0) ELSE tr END
           AS learning_rate,
       CASE WHEN jl IS NOT NULL THEN coalesce({_json_number("elapsed_seconds")}, 0) ELSE 0 END
           AS elapsed_seconds
    FROM fields WHERE jl IS NOT NULL OR tl IS NOT NULL)"""


@query(f"WITH {_parsed_sql('v_log_lines')} SELECT * FROM parsed")
def parse_log(t: Tables) -> DataFrame:
    return MO.parse_log(t.log_lines()).drop("style", "grad_norm")


_TAIL = """tail AS (SELECT * FROM v_log_lines
    QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY ord DESC) <= 20)"""


@query(f"WITH {_TAIL}, {_parsed_sql('tail')} SELECT * FROM parsed")
def parse_log_tail(t: Tables) -> DataFrame:
    return MO.parse_log(t.log_lines(), tail_lines=20).drop("style", "grad_norm")


@query("""
SELECT * FROM v_log_lines
QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY ord DESC) <= 20""")
def log_tail(t: Tables) -> DataFrame:
    return MO.log_tail(t.log_lines(), 20)


_PROGRESS = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY ord DESC) AS r,
                  count(*) OVER (PARTITION BY experiment_id) AS points FROM {source}),
ends AS (SELECT experiment_id, max(points) AS points, min(loss) AS best_loss,
       max(step) FILTER (r = 1) AS s1, max(elapsed_seconds) FILTER (r = 1) AS e1,
       max(loss) FILTER (r = 1) AS l1, max(epoch) FILTER (r = 1) AS p1,
       max(step) FILTER (r = CASE WHEN points >= 10 THEN 10 ELSE 2 END) AS s0,
       max(elapsed_seconds) FILTER (r = CASE WHEN points >= 10 THEN 10 ELSE 2 END) AS e0
    FROM ranked GROUP BY experiment_id),
rates AS (SELECT *, CASE WHEN e1 - e0 > 0 THEN (s1 - s0) / (e1 - e0) ELSE 0 END AS rate FROM ends)
"""


@query("WITH " + _PROGRESS.format(source="v_metrics") + """
SELECT r.experiment_id, coalesce(x.status, 'running') AS status, s1 AS current_step,
       coalesce(x.dataset_size * 100, 0) AS total_steps, CAST(trunc(p1) AS BIGINT) AS current_epoch,
       CASE WHEN x.id IS NULL THEN 0 ELSE 3 END AS total_epochs, l1 AS current_loss, r.best_loss,
       e1 AS elapsed_seconds, rate AS steps_per_second,
       CASE WHEN s1 > 0 AND x.dataset_size > 0 AND rate > 0
            THEN (x.dataset_size * 100 - s1) / rate ELSE 0 END AS estimated_remaining_seconds,
       points
FROM rates r LEFT JOIN v_experiments x ON x.id = r.experiment_id""", longs=("total_epochs",))
def progress(t: Tables) -> DataFrame:
    runs = t.experiments().select(
        F.col("id").alias("experiment_id"), "status",
        (F.col("dataset_size") * 100).alias("total_steps"), F.lit(3).cast("long").alias("total_epochs"),
    )
    return MO.progress(t.metrics(), runs)


@query(f"""WITH {_parsed_sql('v_log_lines')}, {_PROGRESS.format(source="parsed")}
SELECT experiment_id, s1 AS current_step, CAST(trunc(p1) AS BIGINT) AS current_epoch,
       l1 AS current_loss, best_loss, e1 AS elapsed_seconds, rate AS steps_per_second, points
FROM rates""")
def stream_progress(t: Tables) -> DataFrame:
    """The log lines of all events, written as growing logs and followed to their end."""
    logs = scratch_path(t.spark, "logs")
    # A set number of partitions: one file per experiment takes time, however few bytes it has.
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    lines = t.log_lines().repartition(parts, "experiment_id")
    write_logs(lines, logs, "experiment_id", "ord")
    out = scratch_path(t.spark, "snapshots")
    SP.write_snapshots(SP.log_stream(t.spark, f"{logs}/*"), out, scratch_path(t.spark, "offsets"),
                       availableNow=True).awaitTermination()
    return SP.latest_snapshots(t.spark, out)


_SAMPLES = f"""
WITH logs AS (SELECT ord AS log_id, string_agg(CASE WHEN i = 0 THEN 'start' || chr(10) ELSE
        'predict_' || (ord * 10 + i) || ' {{"x": 1,' || chr(10) || '"input": "'
        || replace(replace(text, '"', ''''), chr(92), '/') || '",' || chr(10) || '"predict": "p' || i
        || '", "label": "' || replace(replace(text, '"', ''''), chr(92), '/') || '"}}' || chr(10)
        END, '' ORDER BY i) AS log
    FROM v_docs, unnest(range(ord % 5 + 1)) AS u(i) GROUP BY ord),
found AS (SELECT log_id, regexp_extract_all(log, '{SAMPLE_BLOCK}', 1) AS g1,
        regexp_extract_all(log, '{SAMPLE_BLOCK}', 2) AS g2,
        regexp_extract_all(log, '{SAMPLE_BLOCK}', 3) AS g3,
        regexp_extract_all(log, '{SAMPLE_BLOCK}', 4) AS g4 FROM logs),
each AS (SELECT log_id, len(g1) AS n, unnest(range(1, len(g1) + 1)) AS i, g1, g2, g3, g4 FROM found)
"""


@query(_SAMPLES + """
SELECT log_id, i - greatest(n - 2, 1) AS n, g1[i] AS step, g2[i] AS input, g3[i] AS predict,
       g4[i] AS label
FROM each WHERE i > n - 3""")
def sample_outputs(t: Tables) -> DataFrame:
    return S.sample_outputs(t.sample_lines())


@query(_SAMPLES + """
SELECT log_id, i - greatest(n - 2, 1) AS n, g1[i] AS step, left(g2[i], 200) AS input,
       left(g3[i], 500) AS predict, left(g4[i], 500) AS label
FROM each WHERE i > n - 3""")
def sample_outputs_cut(t: Tables) -> DataFrame:
    return S.sample_outputs(t.sample_lines(), limits=SAMPLE_LIMITS)


@query("""
SELECT experiment_id, ord, step, loss FROM v_metrics
UNION ALL SELECT experiment_id, ord, step + 1000000, loss / 2 FROM v_metrics""")
def metric_append(t: Tables) -> DataFrame:
    """Metric rows appended to a stored table twice."""
    path, columns = scratch_path(t.spark, "metrics"), ["experiment_id", "ord", "step", "loss"]
    E.append_metrics(t.metrics().select(columns), path)
    E.append_metrics(t.metrics().select(columns).withColumns(
        {"step": F.col("step") + 1_000_000, "loss": F.col("loss") / 2}), path)
    return t.spark.read.parquet(path)


_SUMMARY = """
rows AS (SELECT run_id, ord, TRY_CAST(json_extract_string(line, '$.loss') AS DOUBLE) AS loss,
                json_extract_string(line, '$.elapsed_time') AS elapsed,
                CAST(json_extract_string(line, '$.current_steps') AS BIGINT) AS steps,
                CAST(json_extract_string(line, '$.epoch') AS DOUBLE) AS epoch
         FROM v_trainer_lines WHERE trim(line) <> ''),
summary AS (SELECT run_id, arg_min(loss, ord) FILTER (loss IS NOT NULL) AS initial_loss,
                   arg_max(loss, ord) FILTER (loss IS NOT NULL) AS final_loss,
                   arg_max(elapsed, ord) AS duration, arg_max(steps, ord) AS steps,
                   arg_max(epoch, ord) AS epochs
            FROM rows GROUP BY run_id)"""


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def run_summary(t: Tables) -> DataFrame:
    return MO.run_summary(t.trainer_lines())


@query(f"""WITH {_SUMMARY}
SELECT e.id AS run_id, e.model_name AS name, e.vram_peak_gb AS params_b, initial_loss,
       s.final_loss, duration, steps, CASE WHEN coalesce(s.final_loss, 0) <> 0
           THEN (initial_loss - s.final_loss) / initial_loss * 100 END AS drop_pct,
       coalesce(s.final_loss, 0) = 0 AS failed
FROM v_experiments e LEFT JOIN summary s ON s.run_id = e.id""")
def run_report(t: Tables) -> DataFrame:
    runs = t.experiments().select(F.col("id").alias("run_id"), F.col("model_name").alias("name"),
                                  F.col("vram_peak_gb").alias("params_b"))
    return MO.run_report(runs, t.trainer_lines())


@query("""
SELECT experiment_id, step, loss,
       lag(loss) OVER (PARTITION BY experiment_id ORDER BY step) AS previous_loss,
       loss - lag(loss) OVER (PARTITION BY experiment_id ORDER BY step) AS delta
FROM v_metrics""")
def loss_deltas(t: Tables) -> DataFrame:
    return MO.loss_deltas(t.metrics())


@query("""
SELECT experiment_id, ord, step, round_even(epoch * 100, 0) / 100 AS epoch,
       round_even(loss * 10000, 0) / 10000 AS loss,
       learning_rate AS lr, elapsed_seconds AS time
FROM v_metrics""")
def history_rows(t: Tables) -> DataFrame:
    return MO.history_rows(t.metrics())
