"""Queries on memory budgets, parameter rules and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.operators import budget as B
from tuneprep.plans.registry import query
from tuneprep.plans.tables import Tables
from tuneprep.rules import terms

GIB = "CAST(1073741824 AS DOUBLE)"


def _parts(method: str, bytes_: str, batch: str, seq: str) -> dict[str, str]:
    """SQL of the budget parts; ``p`` is the parameter count."""
    p = "(params_b * CAST(1000000000 AS DOUBLE))"
    layers = (f"CASE WHEN {p} < 2e9 THEN 24 WHEN {p} < 8e9 THEN 32 WHEN {p} < 15e9 THEN 40 "
              f"WHEN {p} < 40e9 THEN 60 ELSE 80 END")
    weights = (f"{p} * CASE WHEN {method} = 'qlora' THEN CAST(0.5 AS DOUBLE) "
               f"ELSE CAST({bytes_} AS DOUBLE) END / {GIB}")
    hidden = f"greatest(1024, floor(sqrt({p} / ({layers}) / 4)))"
    tokens = f"CAST({batch} * {seq} AS DOUBLE)"
    return {
        "model_weight_gb": weights,
        "optimizer_state_gb": f"CASE WHEN {method} IN ('qlora', 'lora') "
                              f"THEN {p} * CAST(0.01 AS DOUBLE) * 2 * 3 / {GIB} "
                              f"ELSE {p} * CAST({bytes_} AS DOUBLE) * 3 / {GIB} END",
        "activation_gb": f"{hidden} * ({layers}) * 2 * {tokens} / {GIB} * CAST(0.4 AS DOUBLE)",
        "data_gb": f"{tokens} * 2 / {GIB} * 3",
        "overhead_gb": f"({weights}) * CAST(0.15 AS DOUBLE) + CAST(0.5 AS DOUBLE)",
    }


def _total(parts: dict[str, str]) -> str:
    return " + ".join(f"({p})" for p in parts.values())


def _budget_sql() -> str:
    parts = _parts("method", "CASE WHEN method = 'qlora' THEN 0.5 ELSE 2 END", "batch_size",
                   "max_seq_length")
    columns = ", ".join(f"round({sql}, 9) AS {name}" for name, sql in parts.items())
    return f"""
SELECT model_id, method, batch_size, max_seq_length, {columns},
       round({_total(parts)}, 9) AS total_estimate_gb
FROM v_models, (VALUES ('qlora'), ('lora'), ('full')) m(method),
     (VALUES (1), (4)) b(batch_size), (VALUES (1024), (2048)) s(max_seq_length)"""


@query(_budget_sql(), longs=("batch_size", "max_seq_length"))
def memory_budget(t: Tables) -> DataFrame:
    rows = B.memory_budgets(t.models().select("model_id", "params_b"))
    names = [*_parts("", "", "", ""), "total_estimate_gb"]
    return rows.select(
        "model_id", "method", F.col("batch_size").cast("long").alias("batch_size"),
        F.col("max_seq_length").cast("long").alias("max_seq_length"),
        *[F.round(n, 9).alias(n) for n in names],
    )


def _fits(method: str, bytes_: str) -> str:
    total = _total(_parts(f"'{method}'", bytes_, "4", "2048"))
    return f"round_even(({total}) * 100, 0) / 100 <= vram_gb * CAST(0.85 AS DOUBLE) AS {method}_fits"


@query(f"SELECT model_id, params_b, vram_gb, {_fits('qlora', '0.5')}, {_fits('lora', '2')}, "
       f"{_fits('full', '2')} FROM v_models")
def feasibility_matrix(t: Tables) -> DataFrame:
    return B.feasibility_matrix(t.models().select("model_id", "params_b", "vram_gb"))


@query("""
SELECT model_id, CASE WHEN vram_gb >= size_gb THEN 'lora' ELSE 'qlora' END AS by_need,
       CASE WHEN vram_gb >= 8 THEN 'lora' ELSE 'qlora' END AS by_bound,
       CASE WHEN params_b < 10 THEN 16 ELSE 32 END AS sweep_rank
FROM v_models""", longs=("sweep_rank",))
def sweep_method(t: Tables) -> DataFrame:
    runs = t.models().select("model_id", "params_b", "vram_gb", F.col("size_gb").alias("lora_vram_gb"))
    return B.sweep_method(runs).select("model_id", "by_need", "by_bound",
                                       F.col("sweep_rank").cast("long").alias("sweep_rank"))


@query("""
SELECT request_id, vram_gb, CASE WHEN vram_gb >= 6 THEN 'qlora' ELSE 'insufficient' END
           AS recommended,
       CASE WHEN vram_gb >= 40 THEN 'qlora,lora,full' WHEN vram_gb >= 16 THEN 'qlora,lora'
            WHEN vram_gb >= 6 THEN 'qlora' ELSE '' END AS options,
       CASE WHEN vram_gb < 6 THEN 'insufficient' WHEN vram_gb < 8 THEN 'limited'
            WHEN vram_gb < 16 THEN 'moderate' WHEN vram_gb < 24 THEN 'enough' ELSE 'ample' END
           AS advice
FROM v_requests""")
def method_options(t: Tables) -> DataFrame:
    rows = B.method_options(t.requests().select("request_id", "vram_gb"))
    return rows.withColumn("options", F.array_join("options", ","))


@query("""
SELECT model_id, 'qlora' AS finetuning_type,
       CASE WHEN params_b <= 2 THEN 8 WHEN params_b <= 8 THEN 16 WHEN params_b <= 15 THEN 32
            ELSE 64 END AS lora_rank,
       CASE WHEN params_b <= 2 THEN 16 WHEN params_b <= 8 THEN 32 WHEN params_b <= 15 THEN 64
            ELSE 128 END AS lora_alpha,
       CAST(0.0002 AS DOUBLE) AS learning_rate,
       CASE WHEN dataset_size < 1000 THEN 10 WHEN dataset_size < 5000 THEN 5
            WHEN dataset_size < 20000 THEN 3 ELSE 2 END AS num_train_epochs,
       CASE WHEN vram_gb < 8 THEN 1 WHEN vram_gb < 16 THEN 2 WHEN vram_gb < 24 THEN 4 ELSE 8 END
           AS per_device_train_batch_size,
       CASE WHEN vram_gb < 8 THEN 8 WHEN vram_gb < 24 THEN 4 ELSE 2 END
           AS gradient_accumulation_steps,
       CASE WHEN vram_gb < 8 THEN 512 WHEN vram_gb < 12 THEN 1024 WHEN vram_gb < 24 THEN 2048
            ELSE 4096 END AS max_seq_length
FROM v_models""",
       longs=("lora_rank", "lora_alpha", "num_train_epochs", "per_device_train_batch_size", "gradient_accumulation_steps", "max_seq_length"))
def smart_params(t: Tables) -> DataFrame:
    rows = B.smart_params(t.models().select("model_id", "params_b", "vram_gb", "dataset_size"))
    whole = ["lora_rank", "lora_alpha", "num_train_epochs", "per_device_train_batch_size",
             "gradient_accumulation_steps", "max_seq_length"]
    return rows.select("model_id", "finetuning_type", "learning_rate",
                       *[F.col(c).cast("long").alias(c) for c in whole])


def _preset_case(key: str) -> str:
    i = terms.CONFIG_KEYS.index(key)
    cases = " ".join(f"WHEN '{n}' THEN {v[i]}" for n, v in terms.PRESETS.items())
    return f"CASE preset {cases} ELSE {terms.PRESETS[terms.DEFAULT_PRESET][i]} END"


_RESOLVED = f"""
resolved AS (SELECT model_id, params_b, vram_gb,
    CASE WHEN finetuning_type = 'auto' THEN 'qlora' ELSE finetuning_type END AS finetuning_type,
    CASE WHEN custom_kind = 2 THEN 0 ELSE {_preset_case("num_train_epochs")} END
        AS num_train_epochs,
    CASE WHEN custom_kind = 1 THEN custom_rank ELSE {_preset_case("lora_rank")} END AS lora_rank,
    {_preset_case("lora_alpha")} AS lora_alpha,
    CAST(CASE WHEN custom_kind = 2 THEN 0.02 ELSE {_preset_case("learning_rate")} END AS DOUBLE)
        AS learning_rate,
    {_preset_case("per_device_train_batch_size")} AS per_device_train_batch_size,
    {_preset_case("gradient_accumulation_steps")} AS gradient_accumulation_steps,
    CASE WHEN custom_kind = 1 THEN custom_seq ELSE {_preset_case("max_seq_length")} END
        AS max_seq_length,
    CASE WHEN custom_kind = 2 THEN 10 ELSE {_preset_case("save_steps")} END AS save_steps
  FROM v_models),
checked AS (SELECT *, {_total(_parts("finetuning_type", "2", "per_device_train_batch_size",
                                     "max_seq_length"))} AS total FROM resolved)"""


@query(f"""WITH {_RESOLVED}
SELECT model_id, finetuning_type, {", ".join(terms.CONFIG_KEYS)},
       round(total, 9) AS total_estimate_gb,
       round_even(total * 100, 0) / 100 <= vram_gb * CAST(0.85 AS DOUBLE) AS is_feasible
FROM checked""",
       longs=("num_train_epochs", "lora_alpha", "per_device_train_batch_size", "gradient_accumulation_steps", "save_steps"))
def config_resolve(t: Tables) -> DataFrame:
    rows = B.resolve_config(_configs(t))
    return rows.select("model_id", "finetuning_type", *terms.CONFIG_KEYS,
                       F.round("total_estimate_gb", 9).alias("total_estimate_gb"), "is_feasible")


def _configs(t: Tables) -> DataFrame:
    return t.models().select("model_id", "params_b", "vram_gb", "dataset_size", "finetuning_type",
                             "preset", "custom_json", "downloads")


@query(f"""WITH {_RESOLVED}, named AS (
    SELECT c.*, CASE WHEN m.downloads % 5 = 0 THEN '' ELSE '/m' END AS model_path,
           CASE WHEN m.downloads % 7 = 0 THEN NULL ELSE '/d' END AS dataset_path,
           m.downloads % 3 <> 0 AS dataset_path_exists
    FROM checked c JOIN v_models m USING (model_id)),
found AS (SELECT model_id, list_filter([
    CASE WHEN model_path = '' THEN 'model_path missing' END,
    CASE WHEN dataset_path IS NULL THEN 'dataset_path missing' END,
    CASE WHEN dataset_path IS NOT NULL AND NOT dataset_path_exists
         THEN 'dataset_path not found' END,
    CASE WHEN lora_rank <= 0 OR lora_rank > 256 THEN 'lora_rank out of range' END,
    CASE WHEN learning_rate <= 0 OR learning_rate > 0.01 THEN 'learning_rate out of range' END,
    CASE WHEN num_train_epochs <= 0 OR num_train_epochs > 100
         THEN 'num_train_epochs out of range' END,
    CASE WHEN max_seq_length < 128 THEN 'max_seq_length too short' END,
    CASE WHEN NOT round_even(total * 100, 0) / 100 <= vram_gb * CAST(0.85 AS DOUBLE)
         THEN 'memory estimate exceeds the available memory' END],
    lambda x: x IS NOT NULL) AS issues,
    CASE WHEN max_seq_length > 32768 THEN 'max_seq_length very large' ELSE '' END AS warnings
  FROM named)
SELECT model_id, array_to_string(issues, '; ') AS issues, warnings, len(issues) = 0 AS valid
FROM found""")
def config_audit(t: Tables) -> DataFrame:
    rows = B.resolve_config(_configs(t)).withColumns({
        "model_path": F.when(F.col("downloads") % 5 == 0, "").otherwise("/m"),
        "dataset_path": F.when(F.col("downloads") % 7 != 0, "/d"),
        "dataset_path_exists": F.col("downloads") % 3 != 0,
    })
    audited = B.audit_config(rows)
    return audited.select("model_id", F.array_join("issues", "; ").alias("issues"),
                          F.array_join("warnings", "; ").alias("warnings"), "valid")


@query("""
SELECT model_id, "option", round(size_gb * size_ratio, 9) AS estimated_size_gb
FROM v_models, (VALUES """ + ", ".join(
    f"('{n}', CAST({r} AS DOUBLE))" for n, r in terms.QUANT_RATIOS) + """) o("option", size_ratio)""")
def quant_sizes(t: Tables) -> DataFrame:
    sized = B.quantised_sizes(t.models().select("model_id", "size_gb"))
    return sized.select("model_id", "option",
                        F.round("estimated_size_gb", 9).alias("estimated_size_gb"))
