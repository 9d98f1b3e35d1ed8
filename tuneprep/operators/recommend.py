"""Model recommendation for a batch of requests.

What a card is worth does not depend on the request alone: its points for every language, task
and level, its fixed reason texts and the settings that its listed source matches are worked out
once per card. A request then looks them up by the places of its keys, adds the points for memory,
sorts and cuts inside its own row; no request is ever shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.catalog import CONFIG, best_method, card_config
from tuneprep.functions.text import fill_template
from tuneprep.rules import terms
from tuneprep.rules.cards import Card, FIRST_HUB, SECOND_HUB, default_cards

LANGUAGES, TASKS = list(terms.LANGUAGE_FAMILIES), list(terms.TASK_TAGS)
LEVELS = list(terms.LEVEL_MAX_PARAMS)
TABLE = (
    "array<struct<ord:int,least:double,allowed:array<boolean>,language:array<double>,"
    "task:array<double>,level:array<double>,hubs:double,display_name:string,platform:string,"
    "source:string,params:string,need:string,zh:boolean,en:boolean,"
    f"listed:struct<training:array<struct<method:string,min_vram_gb:double,config:{CONFIG}>>>>>"
)


def _language_points(card: Card, language: str) -> float:
    families = terms.LANGUAGE_FAMILIES[language]
    if card.family in families:
        return terms.LANGUAGE_POINTS - terms.LANGUAGE_STEP * families.index(card.family)
    return 0.0 if card.family in terms.LANGUAGE_FAMILIES["en"] else terms.OTHER_FAMILY_POINTS


def _task_points(card: Card, task: str) -> float:
    shared = set(terms.TASK_TAGS[task]) & set(card.tags)
    return min(terms.TASK_MOST, terms.TASK_POINTS * len(shared))


def _level_points(card: Card, level: str | None) -> float:
    for low, high, points in terms.LEVEL_POINTS.get(level, []):
        if low <= card.params_b <= high:
            return points
    return 0.0


def _matched(source: str, cards: list[Card]) -> Card | None:
    """The card whose longest pattern is contained in the id; of equal lengths the first."""
    found = [(-len(p), i) for i, c in enumerate(cards) for p in c.patterns if p in source.lower()]
    return cards[min(found)[1]] if found else None


def _entry(place: int, card: Card, cards: list[Card]) -> dict:
    """One card as the look-up table has it; entry 0 of an array is for keys without a row."""
    least = card.training["qlora"].min_vram_gb if "qlora" in card.training else None
    platform, source = card.sources[0] if card.sources else (SECOND_HUB, card.display_name)
    hubs = {p for p, _ in card.sources}
    listed = _matched(source, cards)
    caps = [terms.DEFAULT_LEVEL_PARAMS, *terms.LEVEL_MAX_PARAMS.values()]
    return {
        "ord": place, "least": least, "allowed": [card.params_b <= cap for cap in caps],
        "language": [_language_points(card, x) for x in (terms.DEFAULT_LANGUAGE, *LANGUAGES)],
        "task": [_task_points(card, x) for x in (terms.DEFAULT_TASK, *TASKS)],
        "level": [_level_points(card, x) for x in (None, *LEVELS)],
        "hubs": terms.FIRST_HUB_POINTS * (FIRST_HUB in hubs) + terms.SECOND_HUB_POINTS * (
            SECOND_HUB in hubs),
        "display_name": card.display_name, "platform": platform, "source": source,
        "params": f"{float(card.params_b)}{terms.REASON_PARAMS}",
        "need": None if least is None else str(int(least)),
        "zh": not set(card.tags).isdisjoint(terms.ZH_TAGS), "en": terms.EN_TAG in card.tags,
        "listed": listed and {"training": [
            {"method": m, "min_vram_gb": x.min_vram_gb, "config": card_config(x)}
            for m, x in listed.training.items()]},
    }


def _place(key: str, names: list[str]) -> Column:
    """One-based place of a key in the names, 0 where it is none of them."""
    return F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(key)),
                      F.lit(0)).cast("int")


def _fit_points(least: Column) -> Column:
    ratio = least / F.greatest(F.col("vram_gb"), F.lit(1.0))
    points = F.lit(terms.FIT_LEAST)
    for bound, value in reversed(terms.FIT_POINTS):
        points = F.when(ratio <= bound, value).otherwise(points)
    return points


def _reason(card: Column, score: Column) -> Column:
    tier = F.lit(None).cast("string")
    for bound, text in reversed(terms.SCORE_TIERS):
        tier = F.when(score >= bound, F.lit(text)).otherwise(tier)
    language = F.when(F.col("language").isin("zh", "mixed") & card["zh"], terms.REASON_ZH).when(
        (F.col("language") == "en") & card["en"], terms.REASON_EN
    )
    have = F.bround(F.col("vram_gb"), 0).cast("long").cast("string")
    values = {"need": card["need"], "have": have}
    memory = F.when(F.col("vram_gb") >= card["least"] * 2, fill_template(terms.REASON_AMPLE, values)) \
        .otherwise(fill_template(terms.REASON_TIGHT, values))
    return F.concat_ws(terms.REASON_JOINER, tier, language, card["params"], memory)


def recommend(requests: DataFrame, k: int = 5, cards: list[Card] | None = None) -> DataFrame:
    """Top ``k`` cards per request (task, language, level, vram_gb), ranked from 1."""
    cards = cards or default_cards()
    table = F.from_json(F.lit(json.dumps(
        [_entry(i, c, cards) for i, c in enumerate(cards)], ensure_ascii=False)), TABLE)
    prepared = requests.select(
        "*", _place("language", LANGUAGES).alias("_language"), _place("task", TASKS).alias("_task"),
        _place("level", LEVELS).alias("_level"))
    eligible = F.filter(table, lambda c: F.get(c["allowed"], F.col("_level"))
                        & (c["least"] <= F.col("vram_gb")))
    scored = F.transform(eligible, lambda c: F.struct((-F.round(
        F.get(c["language"], F.col("_language")) + F.get(c["task"], F.col("_task"))
        + _fit_points(c["least"]) + F.get(c["level"], F.col("_level")) + c["hubs"], 1))
        .alias("sort_score"), c["ord"].alias("ord")))
    top = F.slice(F.sort_array(scored), 1, k)
    rows = prepared.select("*", F.posexplode(top).alias("_pos", "_s")).withColumn(
        "_card", F.get(table, F.col("_s.ord")))
    card, score = F.col("_card"), -F.col("_s.sort_score")
    best = best_method(card["listed"], F.col("vram_gb"))
    return rows.select(
        *requests.columns,
        (F.col("_pos") + 1).alias("rank"),
        card["display_name"].alias("display_name"),
        card["source"].alias("model_id"),
        card["platform"].alias("source_platform"),
        score.alias("score"),
        _reason(card, score).alias("reason"),
        # The settings are those of the card that the listed source matches.
        best["method"].alias("method"),
        best["config"].alias("config"))
