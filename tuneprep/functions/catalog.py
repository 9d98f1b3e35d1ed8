"""Expressions over catalogue rows: licence, compatibility, card and template lookup.

The rule tables are short constants, so every lookup is a CASE chain evaluated inside the
scan's projection: no join, no shuffle, no broadcast.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.text import (
    contains_any, first_contained, let, longest_contained,
)
from tuneprep.rules import terms
from tuneprep.rules.cards import Card, DEFAULT_SETTINGS, METHODS, MethodSettings


def licence_class(licence: Column) -> Column:
    """Class of a licence text; outer whitespace is irrelevant to the substring tests."""
    return let(F.lower(licence), lambda text: (
        F.when(text.isNull() | (text == ""), "unknown")
        .when(contains_any(text, terms.FORBIDDEN_LICENCES), "forbidden")
        .when(contains_any(text, terms.RESTRICTED_LICENCES), "restricted")
        .when(contains_any(text, terms.COMMERCIAL_LICENCES), "commercial")
        .when(contains_any(text, terms.RESTRICTED_HINTS), "restricted")
        .when(contains_any(text, terms.FORBIDDEN_HINTS), "forbidden")
        .otherwise("unknown")
    ))


def licence_label(licence: Column, kind: Column) -> Column:
    """Display label of a licence whose class is ``kind``."""
    labels = terms.LICENCE_LABELS
    return (
        F.when(licence.isNull() | (licence == ""), labels["missing"])
        .when(kind == "commercial", labels["commercial"])
        .when(kind == "restricted", labels["restricted"])
        .when(kind == "forbidden", labels["forbidden"])
        .otherwise(labels["unknown"])
    )


def with_licence(models: DataFrame, licence: str = "license") -> DataFrame:
    """Add license_class and license_label."""
    return models.withColumn("license_class", licence_class(F.col(licence))).withColumn(
        "license_label", licence_label(F.col(licence), F.col("license_class"))
    )


def compatibility(model_id: Column, architecture: Column) -> Column:
    """Struct(supported, architecture, reason); reason is architecture/family/unlisted/none."""
    arch = F.coalesce(architecture, F.lit(""))
    known = [(a, a) for a in terms.SUPPORTED_ARCHITECTURES]
    hits = F.struct(
        longest_contained(F.lower(arch), known).alias("arch"),
        longest_contained(F.lower(F.coalesce(model_id, F.lit(""))), known).alias("id"),
    )
    return let(hits, lambda h: F.struct(
        F.coalesce(h["arch"], h["id"]).isNotNull().alias("supported"),
        F.when(arch != "", arch).otherwise(F.coalesce(h["id"], F.lit("unknown")))
        .alias("architecture"),
        F.when(h["arch"].isNotNull(), "architecture")
        .when(h["id"].isNotNull(), "family")
        .when(arch != "", "unlisted")
        .otherwise("none")
        .alias("reason"),
    ))


def card_index(model_id: Column, cards: list[Card]) -> Column:
    """Position of the card whose longest pattern is contained in the id; null when none is."""
    entries = [(p, i) for i, card in enumerate(cards) for p in card.patterns]
    return longest_contained(F.lower(model_id), entries, "int")


CONFIG = "struct<lora_rank:int,lora_alpha:int,lr:double,batch_size:int,max_seq_length:int>"
CARD_SCHEMA = (
    "array<struct<ord:int,id:string,patterns:array<string>,display_name:string,family:string,"
    "chat_template:string,params_b:double,size_gb:double,license:string,"
    "sources:array<struct<platform:string,id:string>>,"
    f"training:array<struct<method:string,min_vram_gb:double,config:{CONFIG}>>,"
    "recommended_datasets:array<string>,tags:array<string>>>"
)


def card_config(values: MethodSettings) -> dict:
    return {k: v for k, v in asdict(values).items() if k != "min_vram_gb"}


def card_column(cards: list[Card]) -> Column:
    """All cards as one constant array of structs, in table order.

    Written as a JSON literal, which the optimizer folds into a constant once per query.
    """
    rows = [
        {
            **asdict(c), "ord": i,
            "sources": [{"platform": p, "id": s} for p, s in c.sources],
            "training": [
                {"method": m, "min_vram_gb": s.min_vram_gb, "config": card_config(s)}
                for m, s in c.training.items()
            ],
        }
        for i, c in enumerate(cards)
    ]
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), CARD_SCHEMA)


def match_card(model_id: Column, cards: list[Card]) -> Column:
    """The matching card struct, or null."""
    return F.get(card_column(cards), card_index(model_id, cards))


def best_method(card: Column, vram_gb: Column) -> Column:
    """Struct(method, config): most demanding method that fits, in qlora < lora < full order."""
    fitting = F.filter(card["training"], lambda m: m["min_vram_gb"] <= vram_gb)
    chosen = F.element_at(fitting, -1)
    default_config = F.from_json(F.lit(json.dumps(card_config(DEFAULT_SETTINGS))), CONFIG)
    default = F.struct(F.lit(METHODS[0]).alias("method"), default_config.alias("config"))
    insufficient = F.struct(
        F.lit("insufficient").alias("method"), F.lit(None).cast(CONFIG).alias("config")
    )
    return (
        F.when(card.isNull(), default)
        .when(F.size(fitting) == 0, insufficient)
        .otherwise(F.struct(chosen["method"].alias("method"), chosen["config"].alias("config")))
    )


def chat_template(model_id: Column, config_template: Column | None = None,
                  longest: bool = False) -> Column:
    """Struct(template_name, confidence, source) for a model id and optional config text."""
    lookup = longest_contained if longest else first_contained
    lowered = F.lower(F.coalesce(model_id, F.lit("")))
    by_config = F.lit(None).cast("string")
    if config_template is not None:
        prefix = F.lower(F.substring(config_template, 1, terms.SIGNATURE_LENGTH))
        for name, example in reversed(terms.CHAT_TEMPLATES.items()):
            start = F.lit(example[: terms.SIGNATURE_LENGTH].lower())
            hit = (config_template != "") & (prefix == start)
            by_config = F.when(hit, F.lit(name)).otherwise(by_config)
    hits = F.struct(
        by_config.alias("config"), lookup(lowered, terms.TEMPLATE_BY_PATTERN).alias("id"),
        contains_any(lowered, ["chat", "instruct"]).alias("hint"),
    )
    return let(hits, lambda h: F.struct(
        F.coalesce(h["config"], h["id"], F.lit("chatml")).alias("template_name"),
        F.when(F.coalesce(h["config"], h["id"]).isNotNull(), "high").otherwise("low")
        .alias("confidence"),
        F.when(h["config"].isNotNull(), "config").when(h["id"].isNotNull(), "model_id")
        .when(h["hint"], "heuristic").otherwise("unknown").alias("source"),
    ))
