"""Memory budgets, feasibility, parameter rules and configuration checks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.functions import sizing as S
from tuneprep.functions.catalog import chat_template
from tuneprep.rules import terms

PRECISION = {"qlora": "4bit", "lora": "bf16", "full": "bf16"}


def _settings(methods, batches, seqs):
    """A constant array of (method, precision, batch, sequence) settings."""
    return F.array(*[
        F.struct(
            F.lit(m).alias("method"), F.lit(PRECISION.get(m, "bf16")).alias("precision"),
            F.lit(b).alias("batch_size"), F.lit(s).alias("max_seq_length"),
        )
        for m in methods for b in batches for s in seqs
    ])


def memory_budgets(models: DataFrame, methods=("qlora", "lora", "full"), batches=(1, 4),
                   seqs=(1024, 2048)) -> DataFrame:
    """Budget rows for each model and setting; settings are exploded from a constant."""
    rows = models.select("*", F.inline(_settings(methods, batches, seqs)))
    parts = S.memory_budget(F.col("params_b"), F.col("method"), F.col("precision"),
                            F.col("batch_size"), F.col("max_seq_length"))
    return rows.select("*", *[c.alias(n) for n, c in parts.items()])


def feasibility_matrix(models: DataFrame, batch: int = 4, seq: int = 2048,
                       vram: str = "vram_gb") -> DataFrame:
    """One column per method: does training fit into 85 % of the memory."""
    columns = []
    for method, precision in PRECISION.items():
        total = S.memory_budget(F.col("params_b"), F.lit(method), F.lit(precision), F.lit(batch),
                                F.lit(seq))["total_estimate_gb"]
        columns.append(S.is_feasible(total, F.col(vram)).alias(f"{method}_fits"))
    return models.select("*", *columns)


def sweep_method(runs: DataFrame, vram: str = "vram_gb") -> DataFrame:
    """Method choice of the two sweep tools: by the model's LoRA need, and by fixed bounds."""
    return runs.select(
        "*",
        F.when(F.col(vram) >= F.col("lora_vram_gb"), "lora").otherwise("qlora").alias("by_need"),
        F.when(F.col(vram) >= 8, "lora").otherwise("qlora").alias("by_bound"),
        F.when(F.col("params_b") < 10, 16).otherwise(32).alias("sweep_rank"),
    )


def method_options(rows: DataFrame, vram: str = "vram_gb") -> DataFrame:
    """Feasible methods, the least demanding one, and the advice band."""
    v = F.col(vram)
    return rows.select(
        "*",
        S.least_demanding_method(v).alias("recommended"),
        S.method_options(v).alias("options"),
        S.memory_advice(v).alias("advice"),
    )


def smart_params(rows: DataFrame) -> DataFrame:
    """Rule-based hyper-parameters from params_b, vram_gb and dataset_size."""
    rules = S.rule_parameters(F.col("params_b"), F.col("vram_gb"), F.col("dataset_size"))
    return rows.select("*", *[c.alias(n) for n, c in rules.items()])


def resolve_config(rows: DataFrame, custom: str = "custom_json") -> DataFrame:
    """Rules, then preset, then custom values; later ones win.

    Reads model_id, params_b, vram_gb, dataset_size, finetuning_type (or auto), preset and a
    JSON text of overrides. Adds the chat template and the memory check of the result.
    """
    kinds = {k: "double" if k == "learning_rate" else "bigint" for k in terms.CONFIG_KEYS}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items())
    rules = S.rule_parameters(F.col("params_b"), F.col("vram_gb"), F.col("dataset_size"))
    given = rows.withColumn("_custom", F.from_json(F.col(custom), schema))
    resolved = given.select(
        *[c for c in rows.columns if c not in ("finetuning_type", custom)],
        F.when(F.col("finetuning_type") == "auto", rules["finetuning_type"])
        .otherwise(F.col("finetuning_type")).alias("finetuning_type"),
        chat_template(F.col("model_id"))["template_name"].alias("chat_template"),
        *[F.coalesce(F.col(f"_custom.{k}"), S.preset_value(F.col("preset"), k).cast(t)).alias(k)
          for k, t in kinds.items()],
    )
    total = S.memory_budget(
        F.col("params_b"), F.col("finetuning_type"), F.lit("bf16"),
        F.col("per_device_train_batch_size"), F.col("max_seq_length"),
    )["total_estimate_gb"]
    return resolved.withColumn("total_estimate_gb", total).withColumn(
        "is_feasible", S.is_feasible(F.col("total_estimate_gb"), F.col("vram_gb"))
    )


def audit_config(rows: DataFrame) -> DataFrame:
    """Add issues, warnings and ``valid``; flags *_exists are optional columns."""
    names = rows.columns

    def missing(column: str):
        return F.coalesce(F.col(column), F.lit("")) == ""

    def absent(column: str):
        flag = f"{column}_exists"
        return ~missing(column) & ~F.col(flag) if flag in names else F.lit(False)

    def outside(column: str, low, high):
        return (F.col(column) <= low) | (F.col(column) > high)

    checks = [
        (missing("model_path"), "model_path missing"),
        (absent("model_path"), "model_path not found"),
        (missing("dataset_path"), "dataset_path missing"),
        (absent("dataset_path"), "dataset_path not found"),
        (outside("lora_rank", 0, 256), "lora_rank out of range"),
        (outside("learning_rate", 0.0, 1e-2), "learning_rate out of range"),
        (outside("num_train_epochs", 0, 100), "num_train_epochs out of range"),
        (outside("per_device_train_batch_size", 0, 128), "batch size out of range"),
        (F.col("max_seq_length") < 128, "max_seq_length too short"),
    ]
    if "is_feasible" in names:
        checks.append((~F.col("is_feasible"), "memory estimate exceeds the available memory"))
    notes = [
        (F.col("max_seq_length") > 32768, "max_seq_length very large"),
        (missing("chat_template"), "chat_template missing"),
    ]

    def collect(pairs):
        return F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in pairs]),
                        lambda x: x.isNotNull())

    return (
        rows.withColumn("issues", collect(checks))
        .withColumn("warnings", collect(notes))
        .withColumn("valid", F.size("issues") == 0)
    )


def quantised_sizes(models: DataFrame, size: str = "size_gb") -> DataFrame:
    """Estimated file size per quantisation option (unrounded)."""
    options = F.array(*[
        F.struct(F.lit(i).alias("option"), F.lit(float(r)).alias("size_ratio"))
        for i, r in terms.QUANT_RATIOS
    ])
    return models.select("*", F.inline(options)).withColumn(
        "estimated_size_gb", F.col(size) * F.col("size_ratio")
    )
