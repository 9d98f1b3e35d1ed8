"""Queries over the model catalogue, and model recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.functions import catalog as C
from tuneprep.operators import catalog as K
from tuneprep.operators import recommend as R
from tuneprep.plans.registry import query
from tuneprep.plans.tables import Tables, sql_text
from tuneprep.rules import terms
from tuneprep.rules.cards import FIRST_HUB, default_cards
from tuneprep.schema import WHITESPACE
from tuneprep.sources.inventory import library_inventory

WS = sql_text(WHITESPACE)
CARDS = default_cards()


def _any(column: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(v)})" for v in values) + ")"


LICENCE_CLASS = f"""CASE WHEN license IS NULL OR license = '' THEN 'unknown'
    WHEN {_any(f"trim(lower(license), {WS})", terms.FORBIDDEN_LICENCES)} THEN 'forbidden'
    WHEN {_any(f"trim(lower(license), {WS})", terms.RESTRICTED_LICENCES)} THEN 'restricted'
    WHEN {_any(f"trim(lower(license), {WS})", terms.COMMERCIAL_LICENCES)} THEN 'commercial'
    WHEN {_any(f"trim(lower(license), {WS})", terms.RESTRICTED_HINTS)} THEN 'restricted'
    WHEN {_any(f"trim(lower(license), {WS})", terms.FORBIDDEN_HINTS)} THEN 'forbidden'
    ELSE 'unknown' END"""
_LABELS = terms.LICENCE_LABELS
LICENCE_LABEL = f"""CASE WHEN license IS NULL OR license = '' THEN '{_LABELS["missing"]}'
    ELSE CASE {LICENCE_CLASS} WHEN 'commercial' THEN '{_LABELS["commercial"]}'
    WHEN 'restricted' THEN '{_LABELS["restricted"]}' WHEN 'forbidden' THEN '{_LABELS["forbidden"]}'
    ELSE '{_LABELS["unknown"]}' END END"""

_KNOWN = "known(name, pos) AS (VALUES " + ", ".join(
    f"({sql_text(a)}, {i})" for i, a in enumerate(terms.SUPPORTED_ARCHITECTURES)) + ")"
_PATTERNS = "patterns(pattern, card) AS (VALUES " + ", ".join(
    f"({sql_text(p)}, {i})" for i, c in enumerate(CARDS) for p in c.patterns) + ")"
_CARD_ROWS = ("cards(card, id, name, family, template, params_b, src, platform, has1, has2, tags) "
              "AS (VALUES " + ", ".join(
                  f"({i}, {sql_text(c.id)}, {sql_text(c.display_name)}, {sql_text(c.family)}, "
                  f"{sql_text(c.chat_template)}, CAST({c.params_b} AS DOUBLE), "
                  f"{sql_text(c.sources[0][1])}, {sql_text(c.sources[0][0])}, "
                  f"{c.sources[0][0] == FIRST_HUB}, {c.sources[-1][0] != FIRST_HUB}, "
                  f"[{', '.join(sql_text(t) for t in c.tags)}])" for i, c in enumerate(CARDS)) + ")")
_METHOD_ROWS = "methods(card, method, pos, min_vram, rank, lr) AS (VALUES " + ", ".join(
    f"({i}, '{m}', {j}, CAST({s.min_vram_gb} AS DOUBLE), "
    f"{'NULL' if s.lora_rank is None else s.lora_rank}, CAST({s.lr} AS DOUBLE))"
    for i, c in enumerate(CARDS) for j, (m, s) in enumerate(c.training.items())) + ")"
_MATCHED = """
hits AS (SELECT m.model_id, p.card FROM v_models m JOIN patterns p
         ON contains(lower(m.model_id), p.pattern)
         QUALIFY row_number() OVER (PARTITION BY m.model_id
                                    ORDER BY length(p.pattern) DESC, p.card) = 1)"""


@query(f"SELECT model_id, {LICENCE_CLASS} AS license_class, {LICENCE_LABEL} AS license_label "
       "FROM v_models")
def license_class(t: Tables) -> DataFrame:
    tagged = C.with_licence(t.models().select("model_id", "license"))
    return tagged.drop("license")


@query(f"""
WITH {_KNOWN},
by_arch AS (SELECT model_id, arg_max(name, [length(name), -pos]) AS hit FROM v_models, known
            WHERE contains(lower(architecture), name) GROUP BY model_id),
by_id AS (SELECT model_id, arg_max(name, [length(name), -pos]) AS hit FROM v_models, known
          WHERE contains(lower(model_id), name) GROUP BY model_id)
SELECT m.model_id, a.hit IS NOT NULL OR i.hit IS NOT NULL AS supported,
       CASE WHEN m.architecture <> '' THEN m.architecture ELSE coalesce(i.hit, 'unknown') END
           AS architecture,
       CASE WHEN a.hit IS NOT NULL THEN 'architecture' WHEN i.hit IS NOT NULL THEN 'family'
            WHEN m.architecture <> '' THEN 'unlisted' ELSE 'none' END AS reason
FROM v_models m LEFT JOIN by_arch a USING (model_id) LEFT JOIN by_id i USING (model_id)""")
def compatibility(t: Tables) -> DataFrame:
    checked = C.compatibility(F.col("model_id"), F.col("architecture"))
    return t.models().select("model_id", checked.alias("c")).select("model_id", "c.*")


@query(f"""
WITH capped AS (SELECT *, {LICENCE_CLASS} AS license_class, {LICENCE_LABEL} AS license_label
                FROM v_models WHERE {LICENCE_CLASS} = 'commercial'
                QUALIFY row_number() OVER (PARTITION BY source ORDER BY downloads DESC, model_id)
                        <= 16)
SELECT model_id, source, downloads, license_class, license_label,
       array_to_string(tags, ',') AS tags
FROM capped ORDER BY downloads DESC, model_id LIMIT 30""")
def merged_search(t: Tables) -> DataFrame:
    models = t.models().withColumn("tags", F.array_join("tags", " , "))
    found = K.merged_search(models, limit=30, licence="commercial")
    return found.select("model_id", "source", "downloads", "license_class", "license_label",
                        F.array_join("tags", ",").alias("tags"))


@query(f"""
WITH {_PATTERNS}, {_CARD_ROWS}, {_METHOD_ROWS}, {_MATCHED}
SELECT m.model_id, c.id AS card_id, c.name AS card_name, c.family AS card_family,
       c.params_b AS card_params_b, q.min_vram AS card_min_vram
FROM v_models m LEFT JOIN hits h USING (model_id) LEFT JOIN cards c USING (card)
LEFT JOIN methods q ON q.card = c.card AND q.method = 'qlora'""")
def card_match(t: Tables) -> DataFrame:
    return K.with_card(t.models().select("model_id"))


@query(f"""
WITH {_PATTERNS}, {_CARD_ROWS}, {_METHOD_ROWS}, {_MATCHED},
levels AS (SELECT *, CASE origin WHEN 'online' THEN 0 WHEN 'cache' THEN 1 ELSE 2 END AS lvl
           FROM v_searches),
best AS (SELECT *, min(lvl) OVER (PARTITION BY search_id) AS top FROM levels),
kept AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY downloads DESC, model_id)
                AS rank, count(*) OVER (PARTITION BY search_id) AS total
         FROM best WHERE lvl = top)
SELECT search_id, origin, k.model_id, downloads, k.rank, total,
       CASE WHEN origin <> 'local' THEN c.name END AS card_name,
       CASE WHEN origin <> 'local' THEN q.min_vram END AS card_min_vram
FROM kept k LEFT JOIN hits h USING (model_id) LEFT JOIN cards c USING (card)
LEFT JOIN methods q ON q.card = c.card AND q.method = 'qlora'
WHERE k.rank <= 5""")
def enriched_search(t: Tables) -> DataFrame:
    found = K.enriched_search(t.searches(), limit=5)
    return found.select("search_id", "origin", "model_id", "downloads",
                        F.col("rank").cast("long").alias("rank"), "total", "card_name",
                        "card_min_vram")


@query("""
WITH split AS (SELECT string_split(substr(path, 9), '/') AS p, length FROM v_files),
local AS (SELECT replace(p[1], '--', '/') AS model_id, sum(length) / 1073741824 AS size_gb,
                 count(*) AS file_count
          FROM split WHERE NOT starts_with(p[-1], '.') GROUP BY p[1])
SELECT coalesce(r.model_id, l.model_id) AS model_id, coalesce(l.size_gb, r.size_gb) AS size_gb,
       r.downloads, r.license, l.file_count, l.model_id IS NOT NULL AS is_downloaded
FROM v_models r FULL JOIN local l ON l.model_id = r.model_id""")
def detail_merge(t: Tables) -> DataFrame:
    remote = t.models().select("model_id", "size_gb", "downloads", "license")
    local = library_inventory(t.files(), "/models").select("model_id", "size_gb", "file_count")
    return K.detail_merge(remote, local)


@query("""
SELECT ord, display_name, family, params_b FROM v_cards
WHERE params_b BETWEEN 5 AND 40 AND list_contains(tags, 'ECONOMY')
  AND (len(list_filter(patterns, lambda p: contains(p, 'ring'))) > 0
       OR contains(lower(display_name), 'ring') OR contains(family, 'ring')
       OR len(list_filter(tags, lambda p: contains(p, 'ring'))) > 0)""")
def card_search(t: Tables) -> DataFrame:
    found = K.search_cards(t.cards(), query="Ring", tag="ECONOMY", min_params=5, max_params=40)
    return found.select("ord", "display_name", "family", "params_b")


@query(f"""
WITH {_PATTERNS}, {_CARD_ROWS}, {_METHOD_ROWS}, {_MATCHED},
fit AS (SELECT m.model_id, arg_max(q.method, q.pos) AS method, arg_max(q.lr, q.pos) AS lr,
               CAST(arg_max(coalesce(q.rank, -1), q.pos) AS BIGINT) AS rank
        FROM v_models m JOIN hits h USING (model_id) JOIN methods q USING (card)
        WHERE q.min_vram <= m.vram_gb GROUP BY m.model_id)
SELECT m.model_id, m.vram_gb, c.id AS card_id, c.template AS chat_template,
       CASE WHEN c.id IS NULL THEN 'qlora' ELSE coalesce(f.method, 'insufficient') END
           AS recommended_method,
       CASE WHEN c.id IS NULL THEN CAST(0.0002 AS DOUBLE) ELSE f.lr END AS lr,
       CASE WHEN c.id IS NULL THEN 16 WHEN f.rank >= 0 THEN f.rank END AS lora_rank
FROM v_models m LEFT JOIN hits h USING (model_id) LEFT JOIN cards c USING (card)
LEFT JOIN fit f USING (model_id)""")
def best_method(t: Tables) -> DataFrame:
    chosen = K.best_method(t.models().select("model_id", "vram_gb"))
    return chosen.select("model_id", "vram_gb", "card_id", "chat_template", "recommended_method",
                         F.col("config.lr").alias("lr"),
                         F.col("config.lora_rank").cast("long").alias("lora_rank"))


@query(f"""
WITH {_PATTERNS}, {_CARD_ROWS}, {_MATCHED}
SELECT DISTINCT family FROM hits JOIN cards USING (card)""")
def families(t: Tables) -> DataFrame:
    matched = K.with_card(t.models().select("model_id")).filter(F.col("card_family").isNotNull())
    return K.families(matched.select(F.col("card_family").alias("family")))


@query("""
SELECT family, arg_min(display_name, ord) AS display_name, min(ord) AS ord
FROM v_cards GROUP BY family""")
def lookup_first(t: Tables) -> DataFrame:
    return K.lookup_first(t.cards(), "family", "display_name")


def _template_sql() -> str:
    rows = ", ".join(f"({sql_text(p)}, {sql_text(v)}, {i})"
                     for i, (p, v) in enumerate(terms.TEMPLATE_BY_PATTERN))
    configs = " ".join(
        f"WHEN config_template <> '' AND lower(left(config_template, {terms.SIGNATURE_LENGTH})) = "
        f"{sql_text(x[:terms.SIGNATURE_LENGTH].lower())} THEN {sql_text(n)}"
        for n, x in terms.CHAT_TEMPLATES.items())
    return f"""
WITH names(pattern, template, pos) AS (VALUES {rows}),
by_id AS (SELECT model_id, arg_min(template, pos) AS hit FROM v_models, names
          WHERE contains(lower(model_id), pattern) GROUP BY model_id),
found AS (SELECT m.model_id, CASE {configs} END AS conf, i.hit FROM v_models m
          LEFT JOIN by_id i USING (model_id))
SELECT model_id, coalesce(conf, hit, 'chatml') AS template_name,
       CASE WHEN coalesce(conf, hit) IS NOT NULL THEN 'high' ELSE 'low' END AS confidence,
       CASE WHEN conf IS NOT NULL THEN 'config' WHEN hit IS NOT NULL THEN 'model_id'
            WHEN contains(lower(model_id), 'chat') OR contains(lower(model_id), 'instruct')
            THEN 'heuristic' ELSE 'unknown' END AS source
FROM found"""


@query(_template_sql())
def template_detect(t: Tables) -> DataFrame:
    models = t.models().select("model_id", "config_template")
    return K.detect_templates(models, "config_template").drop("config_template")


def _preference_sql(table: dict[str, list[str]], column: str, default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN [{', '.join(sql_text(v) for v in vs)}]"
                     for k, vs in table.items())
    rest = ", ".join(sql_text(v) for v in table[default])
    return f"CASE {column} {cases} ELSE [{rest}] END"


def _recommend_sql() -> str:
    caps = " ".join(f"WHEN '{k}' THEN {v}" for k, v in terms.LEVEL_MAX_PARAMS.items())
    en = ", ".join(sql_text(f) for f in terms.LANGUAGE_FAMILIES["en"])
    tiers = " ".join(f"WHEN score >= {b} THEN {sql_text(s)}" for b, s in terms.SCORE_TIERS)
    zh = " OR ".join(f"list_contains(tags, {sql_text(z)})" for z in terms.ZH_TAGS)
    ample, tight = sql_text(terms.REASON_AMPLE), sql_text(terms.REASON_TIGHT)
    return f"""
WITH {_PATTERNS}, {_CARD_ROWS}, {_METHOD_ROWS},
r AS (SELECT *, CASE level {caps} ELSE {terms.DEFAULT_LEVEL_PARAMS} END AS cap,
             {_preference_sql(terms.LANGUAGE_FAMILIES, "language", "zh")} AS fams,
             {_preference_sql(terms.TASK_TAGS, "task", "chat")} AS prefs FROM v_requests),
e AS (SELECT r.*, c.*, q.min_vram FROM r JOIN cards c ON c.params_b <= r.cap
      JOIN methods q ON q.card = c.card AND q.method = 'qlora' AND q.min_vram <= r.vram_gb),
s AS (SELECT *, CAST(
        CASE WHEN list_contains(fams, family) THEN 35 - (list_position(fams, family) - 1) * 7
             WHEN family NOT IN ({en}) THEN 10 ELSE 0 END
        + least(30, 10 * len(list_filter(prefs, lambda x: list_contains(tags, x))))
        + CASE WHEN min_vram / greatest(vram_gb, 1) <= 0.3 THEN 20
               WHEN min_vram / greatest(vram_gb, 1) <= 0.5 THEN 15
               WHEN min_vram / greatest(vram_gb, 1) <= 0.7 THEN 10 ELSE 5 END
        + CASE level WHEN 'beginner' THEN CASE WHEN params_b <= 3 THEN 10
                                               WHEN params_b <= 7 THEN 5 ELSE 0 END
               WHEN 'intermediate' THEN CASE WHEN params_b BETWEEN 3 AND 14 THEN 10 ELSE 5 END
               WHEN 'advanced' THEN CASE WHEN params_b BETWEEN 7 AND 40 THEN 10 ELSE 5 END
               ELSE 0 END
        + CASE WHEN has1 THEN 3 ELSE 0 END + CASE WHEN has2 THEN 2 ELSE 0 END AS DOUBLE) AS score
      FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, card) AS rnk FROM s),
same AS (SELECT c.card, p.card AS match FROM cards c JOIN patterns p
         ON contains(lower(c.src), p.pattern)
         QUALIFY row_number() OVER (PARTITION BY c.card ORDER BY length(p.pattern) DESC, p.card) = 1),
best AS (SELECT k.request_id, k.card, arg_max(q.method, q.pos) AS best_method,
                arg_max(q.lr, q.pos) AS best_lr, arg_max(coalesce(q.rank, -1), q.pos) AS best_rank
         FROM k JOIN same USING (card) JOIN methods q ON q.card = same.match
         WHERE q.min_vram <= k.vram_gb AND k.rnk <= 5 GROUP BY k.request_id, k.card)
SELECT k.request_id, rnk AS rank, name AS display_name, src AS model_id,
       platform AS source_platform, score,
       concat_ws({sql_text(terms.REASON_JOINER)}, CASE {tiers} END,
           CASE WHEN language IN ('zh', 'mixed') AND ({zh}) THEN {sql_text(terms.REASON_ZH)}
                WHEN language = 'en' AND list_contains(tags, {sql_text(terms.EN_TAG)})
                THEN {sql_text(terms.REASON_EN)} END,
           params_b || {sql_text(terms.REASON_PARAMS)},
           CASE WHEN vram_gb >= min_vram * 2
                THEN replace(replace({ample}, '{{need}}', CAST(CAST(min_vram AS BIGINT) AS VARCHAR)),
                     '{{have}}', CAST(CAST(round_even(vram_gb, 0) AS BIGINT) AS VARCHAR))
                ELSE replace({tight}, '{{need}}', CAST(CAST(min_vram AS BIGINT) AS VARCHAR))
                END) AS reason,
       CASE WHEN same.match IS NULL THEN 'qlora' ELSE coalesce(best_method, 'insufficient') END
           AS method,
       CASE WHEN same.match IS NULL THEN CAST(0.0002 AS DOUBLE) ELSE best_lr END AS lr,
       CASE WHEN same.match IS NULL THEN 16 WHEN best_rank >= 0 THEN best_rank END AS lora_rank
FROM k LEFT JOIN same USING (card) LEFT JOIN best ON best.request_id = k.request_id
     AND best.card = k.card
WHERE rnk <= 5"""


@query(_recommend_sql())
def recommend(t: Tables) -> DataFrame:
    ranked = R.recommend(t.requests(), 5)
    return ranked.select("request_id", F.col("rank").cast("long").alias("rank"), "display_name",
                         "model_id", "source_platform", "score", "reason", "method",
                         F.col("config.lr").alias("lr"), F.col("config.lora_rank").alias("lora_rank"))
