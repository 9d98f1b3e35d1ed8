"""Memory, size and parameter formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneprep.functions.text import round_even, step_table
from tuneprep.rules import terms

GIB = float(1024 ** 3)
ADAPTER_SHARE = 0.01
CHECKPOINTING_FACTOR = 0.4
SAFETY = 0.85


def memory_budget(params_b: Column, method: Column, precision: Column, batch: Column,
                  seq: Column, checkpointing: bool = True) -> dict[str, Column]:
    """Unrounded GiB per component and in total."""
    params = params_b * F.lit(1e9)
    width = F.lit(None).cast("double")
    for name, size in terms.BYTES_PER_PARAM.items():
        width = F.when(precision == name, F.lit(size)).otherwise(width)
    half = F.lit(terms.BYTES_PER_PARAM["bf16"])
    per_weight = F.when(method == "qlora", F.lit(terms.BYTES_PER_PARAM["4bit"])).otherwise(width)
    weights = params * per_weight / GIB
    optimizer = F.when(
        method.isin("qlora", "lora"), params * F.lit(ADAPTER_SHARE) * half * 3 / GIB
    ).otherwise(params * width * 3 / GIB)
    layers = step_table(params, terms.LAYERS_BELOW, terms.LAYERS_MAX)
    hidden = F.greatest(F.lit(1024).cast("long"), F.floor(F.sqrt(params / layers / 4)))
    tokens = (batch * seq).cast("double")
    activation = hidden * layers * 2 * tokens / GIB
    if checkpointing:
        activation = activation * CHECKPOINTING_FACTOR
    data = tokens * 2 / GIB * 3
    overhead = weights * 0.15 + 0.5
    return {
        "model_weight_gb": weights,
        "optimizer_state_gb": optimizer,
        "activation_gb": activation,
        "data_gb": data,
        "overhead_gb": overhead,
        "total_estimate_gb": weights + optimizer + activation + data + overhead,
    }


def is_feasible(total_gb: Column, vram_gb: Column) -> Column:
    return round_even(total_gb, 2) <= vram_gb * SAFETY


def least_demanding_method(vram_gb: Column) -> Column:
    """First method the memory reaches; insufficient below all of them."""
    return F.when(vram_gb >= terms.METHOD_TIERS[0][1], terms.METHOD_TIERS[0][0]).otherwise(
        "insufficient"
    )


def method_options(vram_gb: Column) -> Column:
    """All methods the memory reaches, least demanding first."""
    names = F.array(*[F.when(vram_gb >= bound, F.lit(m)) for m, bound in terms.METHOD_TIERS])
    return F.filter(names, lambda m: m.isNotNull())


def memory_advice(vram_gb: Column) -> Column:
    return F.when(vram_gb < terms.METHOD_TIERS[0][1], "insufficient").otherwise(
        step_table(vram_gb, terms.ADVICE_BELOW, terms.ADVICE_MAX)
    )


def rule_parameters(params_b: Column, vram_gb: Column, rows: Column) -> dict[str, Column]:
    """Hyper-parameters from the step tables."""

    def part(steps: list[tuple], i: int) -> list[tuple]:
        return [(bound, values[i]) for bound, values in steps]

    method = least_demanding_method(vram_gb)
    method = F.when(method == "insufficient", terms.METHOD_TIERS[0][0]).otherwise(method)
    return {
        "finetuning_type": method,
        "lora_rank": step_table(params_b, part(terms.RANK_UP_TO, 0), terms.RANK_MAX[0],
                                inclusive=True),
        "lora_alpha": step_table(params_b, part(terms.RANK_UP_TO, 1), terms.RANK_MAX[1],
                                 inclusive=True),
        "learning_rate": F.when(method.isin("qlora", "lora"), F.lit(terms.ADAPTER_LR))
        .otherwise(F.lit(terms.FULL_LR)),
        "num_train_epochs": step_table(rows, terms.EPOCHS_BELOW, terms.EPOCHS_MAX),
        "per_device_train_batch_size": step_table(vram_gb, part(terms.BATCH_BELOW, 0),
                                                  terms.BATCH_MAX[0]),
        "gradient_accumulation_steps": step_table(vram_gb, part(terms.BATCH_BELOW, 1),
                                                  terms.BATCH_MAX[1]),
        "max_seq_length": step_table(vram_gb, terms.SEQ_BELOW, terms.SEQ_MAX),
    }


def preset_value(preset: Column, key: str) -> Column:
    """A preset's value; unknown presets read as the standard one."""
    i = terms.CONFIG_KEYS.index(key)
    out = F.lit(terms.PRESETS[terms.DEFAULT_PRESET][i])
    for name, values in terms.PRESETS.items():
        if name != terms.DEFAULT_PRESET:
            out = F.when(preset == name, F.lit(values[i])).otherwise(out)
    return out
