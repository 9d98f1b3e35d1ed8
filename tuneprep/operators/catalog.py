"""Catalogue queries over model rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.functions import catalog as C
from tuneprep.functions.text import base_name, let, matches_glob, strip
from tuneprep.operators.ranking import top_k_per_key
from tuneprep.rules.cards import BUILTIN_DATASETS, Card, default_cards
from tuneprep.rules.terms import DEFAULT_IGNORE

PRIORITY = {"online": 0, "cache": 1, "local": 2}


def tag_models(models: DataFrame, architecture: str | None = None) -> DataFrame:
    """Add licence class and label and the compatibility struct; tags may be a comma string."""
    kind = models.schema["tags"].dataType.simpleString() if "tags" in models.columns else None
    if kind == "string":
        tags = F.transform(F.split("tags", ","), strip)
        models = models.withColumn("tags", F.coalesce(tags, F.array().cast("array<string>")))
    arch = F.col(architecture) if architecture else F.array_join("tags", ",")
    return (
        C.with_licence(models)
        .withColumn("compatibility", C.compatibility(F.col("model_id"), arch))
    )


def merged_search(models: DataFrame, limit: int = 30, licence: str | None = None,
                  query: str | None = None, sources: list[str] | None = None,
                  compat: bool = False, filtered_source: str = "huggingface") -> DataFrame:
    """Top models by downloads over several sources, each capped before the merge.

    ``compat`` applies the licence filter to ``filtered_source`` alone.
    """
    rows = models
    if sources:
        rows = rows.filter(F.col("source").isin(sources))
    if query:
        rows = rows.filter(F.contains(F.lower("model_id"), F.lit(query.lower())))
    if licence:
        match = C.licence_class(F.col("license")) == licence
        rows = rows.filter(match | (F.col("source") != filtered_source) if compat else match)
    per_source = limit if sources and len(sources) == 1 else limit // 2 + 1
    order = [F.col("downloads").desc(), F.col("model_id")]
    capped = top_k_per_key(rows, ["source"], order, per_source)
    return tag_models(capped.orderBy(*order).limit(limit))


def with_card(models: DataFrame, cards: list[Card] | None = None) -> DataFrame:
    """Add the matching card's main fields (null when no card matches)."""
    card = C.match_card(F.col("model_id"), cards or default_cards())
    least = F.element_at(F.filter(card["training"], lambda m: m["method"] == "qlora"), 1)
    return models.withColumn("_card", card).select(
        *models.columns,
        F.col("_card.id").alias("card_id"),
        F.col("_card.display_name").alias("card_name"),
        F.col("_card.family").alias("card_family"),
        F.col("_card.params_b").alias("card_params_b"),
        least["min_vram_gb"].alias("card_min_vram"),
    )


def enriched_search(rows: DataFrame, limit: int = 20,
                    cards: list[Card] | None = None) -> DataFrame:
    """Per search: online rows, else cached rows, else local rows; best ``limit``, with cards.

    ``rows`` carries search_id, origin (online/cache/local), model_id and downloads. The ranking
    puts better origins first, so the rows of the answer are within the top ``limit`` and the
    origin is the first one's. Local rows stay without card.
    """
    level = F.lit(None).cast("int")
    for origin, value in PRIORITY.items():
        level = F.when(F.col("origin") == origin, F.lit(value)).otherwise(level)
    levelled = rows.withColumn("_level", level)
    order = [F.col("_level"), F.col("downloads").desc(), F.col("model_id")]
    best = top_k_per_key(levelled, ["search_id"], order, limit, rank="rank")
    chosen = (
        best.withColumn("_best", F.min("_level").over(Window.partitionBy("search_id")))
        .filter(F.col("_level") == F.col("_best"))
        .drop("_best")
    )
    totals = levelled.groupBy("search_id", "_level").agg(F.count(F.lit(1)).alias("total"))
    enriched = with_card(chosen.join(totals, ["search_id", "_level"]), cards)
    hide = F.col("origin") == "local"
    return enriched.select(*[
        F.when(~hide, F.col(c)).alias(c) if c.startswith("card_") else F.col(c)
        for c in enriched.columns if c != "_level"
    ])


def detail_merge(remote: DataFrame, local: DataFrame, key: str = "model_id") -> DataFrame:
    """Remote and local facts of each model; local values win; flag what is downloaded."""
    shared = [c for c in remote.columns if c in local.columns and c != key]
    r = remote.select(key, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c)
                             for c in remote.columns if c != key])
    rest = [c for c in local.columns if c not in shared and c != key]
    own = local.withColumn("_local", F.lit(True))
    joined = r.join(own, key, "full_outer")
    return joined.select(
        key,
        *[F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) for c in shared],
        *[c for c in remote.columns if c != key and c not in shared],
        *rest,
        F.coalesce(F.col("_local"), F.lit(False)).alias("is_downloaded"),
    )


def search_cards(cards: DataFrame, query: str = "", tag: str = "", min_params: float = 0,
                 max_params: float = 999) -> DataFrame:
    """Cards with the tag, in the size range and naming the query anywhere; smallest first."""
    rows = cards.filter(F.col("params_b").between(min_params, max_params))
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    if query:
        text = query.lower()

        def has(col: Column) -> Column:
            return F.contains(col, F.lit(text))

        rows = rows.filter(
            F.exists("patterns", has) | has(F.lower("display_name")) | has(F.col("family"))
            | F.exists("tags", has)
        )
    return rows.orderBy("params_b", "ord")


def best_method(models: DataFrame, cards: list[Card] | None = None) -> DataFrame:
    """Add the method recommended for (model_id, vram_gb) with its settings."""
    card = C.match_card(F.col("model_id"), cards or default_cards())
    return (
        models.withColumn("_card", card)
        .withColumn("_m", C.best_method(F.col("_card"), F.col("vram_gb")))
        .select(
            *models.columns,
            F.col("_card.id").alias("card_id"),
            F.col("_card.chat_template").alias("chat_template"),
            F.col("_m.method").alias("recommended_method"),
            F.col("_m.config").alias("config"),
        )
    )


def families(cards: DataFrame) -> DataFrame:
    """Distinct families."""
    return cards.select("family").distinct()


def lookup_first(rows: DataFrame, key: str, value: str, ord_col: str = "ord") -> DataFrame:
    """Value of the first row per key."""
    firsts = rows.groupBy(key).agg(F.min(ord_col).alias(ord_col))
    return firsts.join(rows.select(key, ord_col, value), [key, ord_col]).select(key, value, ord_col)


def detect_templates(models: DataFrame, config: str | None = None,
                     longest: bool = False) -> DataFrame:
    template = C.chat_template(F.col("model_id"), F.col(config) if config else None, longest)
    return models.withColumn("_t", template).select(*models.columns, "_t.*")


def filter_files(files: DataFrame, allow: list[str] | None = None,
                 ignore: list[str] | None = None, path: str = "path") -> DataFrame:
    """Files whose base name passes the ignore patterns, then the allow patterns."""
    ignore = DEFAULT_IGNORE if ignore is None else ignore

    def wanted(name: Column) -> Column:
        keep = ~matches_glob(name, ignore)
        return keep & matches_glob(name, allow) if allow else keep

    return files.filter(let(base_name(F.col(path)), wanted))


def card_table(spark, cards: list[Card] | None = None) -> DataFrame:
    """Cards as a DataFrame, in table order."""
    return spark.range(1).select(F.inline(C.card_column(cards or default_cards())))




def builtin_datasets(spark, category: str | None = None) -> DataFrame:
    """The built-in data-set list, optionally of one category."""
    columns = ["id", "name", "category", "format", "record_count", "size_mb", "license", "tags"]
    rows = json.dumps([dict(zip(columns, r)) for r in BUILTIN_DATASETS], ensure_ascii=False)
    schema = ("array<struct<id:string,name:string,category:string,format:string,"
              "record_count:bigint,size_mb:double,license:string,tags:array<string>>>")
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), schema)))
    return table.filter(F.col("category") == category) if category else table
