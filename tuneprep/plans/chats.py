"""Queries over chat records: formats, cleaning, profile, sampling, generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.functions import messages as M
from tuneprep.operators import clean as CL
from tuneprep.operators import formats as FM
from tuneprep.operators import generate as G
from tuneprep.operators import profile as P
from tuneprep.operators import sample as SA
from tuneprep.plans.registry import query
from tuneprep.plans.tables import Tables, sql_text
from tuneprep.rules import terms
from tuneprep.schema import WHITESPACE
from tuneprep.sources.files import parse_qa_lines

WS = sql_text(WHITESPACE)


def _flat(df: DataFrame, *extra: str) -> DataFrame:
    """Message arrays as text, so that results compare by value."""
    line = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return df.select("ord", *extra, F.size("messages").cast("long").alias("n_messages"),
                     F.array_join(line, "\n").alias("chat"))


# --- Formats ---------------------------------------------------------------------------------


@query("""
SELECT ord, CASE ord % 7 WHEN 0 THEN 'sharegpt' WHEN 1 THEN 'conversation' WHEN 6 THEN 'raw'
       ELSE 'alpaca' END AS format
FROM v_docs""")
def detect_format(t: Tables) -> DataFrame:
    mixed = t.mixed()
    return mixed.select("ord", FM.row_format(mixed).alias("format"))


@query("""
SELECT ord, CASE WHEN ord % 7 IN (2, 3, 4, 5) THEN 2 ELSE 1 END AS n_messages,
       CASE WHEN ord % 7 IN (0, 1, 6) THEN 'user:' || text
            WHEN ord % 7 = 3 THEN 'user:' || chr(10) || chr(10) || text || chr(10)
                                  || 'assistant:' || text
            ELSE 'user:' || text || chr(10) || 'assistant:' || text END AS chat
FROM v_docs WHERE length(text) > 0""", longs=("n_messages",))
def mixed_to_messages(t: Tables) -> DataFrame:
    return _flat(FM.to_messages(t.mixed()))


@query("""
SELECT ord, 2 AS n_messages,
       'user:' || instruction || chr(10) || 'assistant:' || output AS chat
FROM v_pairs""", longs=("n_messages",))
def alpaca_to_messages(t: Tables) -> DataFrame:
    return _flat(FM.to_messages(t.pairs(), fmt="alpaca"))


@query("""
SELECT ord, count(*) AS n_messages,
       string_agg(CASE WHEN role = 'assistant' THEN 'assistant:' ELSE 'user:' END || content,
                  chr(10) ORDER BY turn) AS chat
FROM v_turns GROUP BY ord""")
def conv_to_messages(t: Tables) -> DataFrame:
    return _flat(FM.to_messages(t.conversations(), fmt="conversation"))


@query("""
SELECT ord, 2 AS n_messages,
       'user:' || instruction || chr(10) || 'assistant:' || output AS chat
FROM v_pairs""", longs=("n_messages",))
def qa_to_messages(t: Tables) -> DataFrame:
    return _flat(FM.to_messages(t.questions(), fmt="raw"))


_LAST_PAIR = """
SELECT ord, arg_max(content, turn) FILTER (role = 'user') AS instruction, '' AS input,
       arg_max(content, turn) FILTER (role = 'assistant') AS output
FROM v_turns GROUP BY ord
HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0"""


@query(_LAST_PAIR)
def messages_to_alpaca(t: Tables) -> DataFrame:
    return FM.to_alpaca(t.chats())


@query(_LAST_PAIR)
def conv_to_alpaca(t: Tables) -> DataFrame:
    return FM.to_alpaca(t.conversations())


@query(_LAST_PAIR)
def turns_to_alpaca(t: Tables) -> DataFrame:
    return FM.turns_to_alpaca(t.turns())


@query("""
SELECT ord, count(*) AS n_messages,
       string_agg(role || ':' || content, chr(10) ORDER BY turn) AS chat
FROM v_turns GROUP BY ord""")
def assemble_chats(t: Tables) -> DataFrame:
    return _flat(t.chats())


def _render_sql() -> str:
    cases = []
    for i, (name, markup) in enumerate(terms.CHAT_MARKUP.items()):
        (uo, uc), (ao, ac) = markup["user"], markup["assistant"]
        joiner = sql_text(markup["joiner"])
        line = (f"CASE WHEN role = 'assistant' THEN {sql_text(ao)} || content || {sql_text(ac)} "
                f"ELSE {sql_text(uo)} || content || {sql_text(uc)} END")
        cases.append(f"SELECT ord, {sql_text(name)} AS template, "
                     f"string_agg({line}, {joiner} ORDER BY turn) AS rendered "
                     f"FROM v_turns WHERE ord % {len(terms.CHAT_MARKUP)} = {i} "
                     f"GROUP BY ord")
    return "\nUNION ALL\n".join(cases)


@query(_render_sql())
def render_chat(t: Tables) -> DataFrame:
    names = list(terms.CHAT_MARKUP)
    kind = F.col("ord") % len(names)
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, template in enumerate(names):
        name = F.when(kind == i, template).otherwise(name)
        text = F.when(kind == i, M.render_chat(F.col("messages"), template)).otherwise(text)
    return t.chats().select("ord", name.alias("template"), text.alias("rendered"))


@query(f"""
WITH trimmed AS (
    SELECT ord, trim(CASE WHEN ord % 3 = 0 THEN instruction || chr(9) || output || chr(9) || 'x'
                          WHEN ord % 3 = 1 THEN '  ' || instruction ELSE chr(9) END, {WS}) AS line
    FROM v_pairs)
SELECT ord,
       CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 1) END AS question,
       CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 2) END AS answer,
       CASE WHEN NOT contains(line, chr(9)) THEN line END AS instruction,
       CASE WHEN NOT contains(line, chr(9)) THEN '' END AS output
FROM trimmed WHERE line <> ''""")
def read_tsv_qa(t: Tables) -> DataFrame:
    kind = F.col("ord") % 3
    line = F.when(kind == 0, F.concat_ws("\t", "instruction", "output", F.lit("x"))) \
        .when(kind == 1, F.concat(F.lit("  "), F.col("instruction"))).otherwise("\t")
    return parse_qa_lines(t.pairs().select("ord", line.alias("line")), "line")


# --- Cleaning --------------------------------------------------------------------------------

_CHATS = f"""
chat AS (SELECT ord, list({{'role': role, 'content': trim(content, {WS})}} ORDER BY turn) AS m,
                sum(length(trim(content, {WS}))) AS len,
                bool_or(trim(content, {WS}) <> '') AS has_text,
                string_agg(role || ':' || trim(content, {WS}), chr(10) ORDER BY turn) AS chat
         FROM v_turns GROUP BY ord)"""
_DOCS = f"""
chat AS (SELECT ord, trim(text, {WS}) AS m, length(trim(text, {WS})) AS len,
                trim(text, {WS}) <> '' AS has_text, 'user:' || trim(text, {WS}) AS chat
         FROM v_docs)"""


def _judged(low: int) -> str:
    return f"""
marked AS (SELECT *, CASE WHEN NOT has_text THEN 'empty' WHEN len < {low} THEN 'too_short'
                          WHEN len > 8192 THEN 'too_long' ELSE 'pass' END AS verdict FROM chat),
judged AS (SELECT *, CASE WHEN verdict <> 'pass' THEN verdict
                          WHEN row_number() OVER (PARTITION BY verdict, m ORDER BY ord) > 1
                          THEN 'duplicate' ELSE 'kept' END AS outcome FROM marked)"""


def _stats_sql(source: str, low: int) -> str:
    single = "\nUNION ALL\n".join(
        f"SELECT '{o}' AS outcome, count(*) AS n FROM judged WHERE outcome = '{o}'"
        for o in ("kept", "empty", "too_short", "too_long", "duplicate"))
    return f"""WITH {source},{_judged(low)}
SELECT 'total' AS outcome, count(*) AS n FROM judged
UNION ALL SELECT 'removed' AS outcome, count(*) AS n FROM judged WHERE outcome <> 'kept'
UNION ALL {single}"""


@query(_stats_sql(_CHATS, 10))
def clean_stats(t: Tables) -> DataFrame:
    return CL.clean_turn_stats(t.turns())


@query(_stats_sql(_DOCS, 50))
def clean_doc_stats(t: Tables) -> DataFrame:
    return CL.clean_stats(t.doc_records(), CL.CleanOptions(min_length=50))


@query(f"""WITH {_CHATS},{_judged(10)}
SELECT ord, len(m) AS n_messages, chat FROM judged WHERE outcome = 'kept'""")
def clean_chats(t: Tables) -> DataFrame:
    return _flat(CL.clean_turns(t.turns()))


@query(f"""WITH {_DOCS},{_judged(10)}
SELECT ord, 1 AS n_messages, chat FROM judged WHERE outcome = 'kept'""", longs=("n_messages",))
def dedup_exact(t: Tables) -> DataFrame:
    return _flat(CL.clean(t.doc_records()))


@query("""
SELECT ord, instruction, output FROM v_pairs
QUALIFY row_number() OVER (PARTITION BY left(instruction, 50) ORDER BY ord) = 1""")
def dedup_prefix(t: Tables) -> DataFrame:
    return CL.dedup_prefix(t.pairs(), "instruction", 50).select("ord", "instruction", "output")


@query("SELECT ord, text FROM v_docs ORDER BY ord LIMIT 500")
def top_n_cap(t: Tables) -> DataFrame:
    return CL.cap_first(t.documents().select("ord", "text"), 500)


@query("SELECT ord, text AS output FROM v_docs WHERE length(text) > 20")
def answer_len_filter(t: Tables) -> DataFrame:
    return CL.min_answer_length(t.documents().select("ord", F.col("text").alias("output")), 20)


# --- Profile ---------------------------------------------------------------------------------

_LENGTHS = "lens AS (SELECT ord, sum(length(content)) AS len FROM v_turns GROUP BY ord)"


@query("""
SELECT count(DISTINCT ord) AS total_count,
       coalesce(avg(length(content)) FILTER (role = 'user'), 0) AS avg_user_length,
       coalesce(avg(length(content)) FILTER (role = 'assistant'), 0) AS avg_assistant_length
FROM v_turns""")
def role_length_stats(t: Tables) -> DataFrame:
    return P.role_length_stats(P.turn_measures(t.turns()))


@query(f"""WITH {_LENGTHS}
SELECT count(*) AS total_count, CAST(min(len) AS BIGINT) AS min_total_length,
       CAST(max(len) AS BIGINT) AS max_total_length, avg(len) AS avg_total_length,
       CAST(sum(len) AS BIGINT) AS total_characters
FROM lens""")
def record_length_stats(t: Tables) -> DataFrame:
    return P.record_length_stats(P.turn_measures(t.turns()))


def _histogram_sql(lengths: str) -> str:
    rows = ", ".join(f"('{n}', {lo}, {hi if hi is not None else 'NULL'})"
                     for n, lo, hi in terms.LENGTH_BUCKETS)
    return f"""WITH {lengths}, ranges(bucket, lo, hi) AS (VALUES {rows})
SELECT bucket, count(len) AS n FROM ranges
LEFT JOIN lens ON len >= lo AND (hi IS NULL OR len < hi) GROUP BY bucket"""


@query(_histogram_sql(_LENGTHS))
def length_histogram(t: Tables) -> DataFrame:
    return P.length_histogram(P.turn_measures(t.turns()))


@query(_histogram_sql("lens AS (SELECT ord, length(text) AS len FROM v_docs)"))
def doc_length_histogram(t: Tables) -> DataFrame:
    return P.length_histogram(P.record_measures(t.doc_records()))


def _hint_sql(source: str) -> str:
    return f"""
WITH first AS ({source}),
sums AS (SELECT CAST(sum(len(regexp_extract_all(content, '[\\x{{4e00}}-\\x{{9fff}}]'))) AS BIGINT)
                    AS cjk,
                CAST(sum(length(content)) AS BIGINT) AS characters FROM first)
SELECT cjk, characters, CASE WHEN cjk / characters > 0.3 THEN 'zh'
       WHEN cjk / characters > 0.05 THEN 'mixed' ELSE 'en' END AS language_hint FROM sums"""


@query(_hint_sql("SELECT content FROM v_turns ORDER BY ord, turn LIMIT 1000"))
def language_hint(t: Tables) -> DataFrame:
    return P.language_hint(t.turns())


@query(_hint_sql("SELECT content FROM v_turns"))
def language_hint_all(t: Tables) -> DataFrame:
    return P.language_hint(t.turns(), max_messages=None)


# --- Sampling --------------------------------------------------------------------------------


@query("""
SELECT ord, text, CASE WHEN row_number() OVER (ORDER BY md5(ord || ':42'), ord)
       <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'val' END AS split
FROM v_docs""")
def split_train_val(t: Tables) -> DataFrame:
    return SA.split_train_val(t.documents().select("ord", "text"), 0.9, seed=42)


@query("""
SELECT ord, text, CASE WHEN row_number() OVER (ORDER BY ord) <= floor(count(*) OVER () * 0.8)
       THEN 'train' ELSE 'val' END AS split
FROM v_docs""")
def split_in_order(t: Tables) -> DataFrame:
    return SA.split_train_val(t.documents().select("ord", "text"), 0.8, shuffle=False)


@query("""
WITH numbered AS (SELECT ord, text, row_number() OVER (ORDER BY ord) - 1 AS pos,
                         count(*) OVER () AS n FROM v_docs)
SELECT ord, text, pos FROM numbered
WHERE n <= 7 OR pos IN (SELECT i * n // 7 FROM range(7) r(i))""")
def preview_even(t: Tables) -> DataFrame:
    return SA.preview_even(t.documents().select("ord", "text"), 7)


@query("""
SELECT ord, row_number() OVER (ORDER BY md5(ord || ':7'), ord) - 1 AS pos FROM v_docs""")
def shuffle_order(t: Tables) -> DataFrame:
    return SA.shuffle_rows(t.documents().select("ord"), seed=7)


# --- Generation ------------------------------------------------------------------------------


@query("""
WITH plan AS (SELECT o_orderkey AS request_id, o_orderkey % 200 + 1 AS target,
                     least(30, o_orderkey % 200 + 1) AS size FROM orders)
SELECT request_id, batch, least(size, target - batch * size) AS count
FROM plan, unnest(range(CAST(ceil(target / size) AS BIGINT))) AS u(batch)""")
def batch_plan(t: Tables) -> DataFrame:
    requests = t.raw("orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 200 + 1).alias("target_count")
    )
    plan = G.batch_plan(requests)
    return plan.select("request_id", F.col("batch").cast("long").alias("batch"), "count")


def _template_sql(template: str, columns: dict[str, str]) -> str:
    text = sql_text(template)
    for name, column in columns.items():
        text = text.replace("{" + name + "}", f"' || {column} || '")
    return text


_PROMPT_COLUMNS = {"count": "(ord % 30 + 1)", "scenario": "('topic ' || ord)",
                   "examples": "to_json([{'instruction': instruction, 'output': output}])"}


@query(f"""
SELECT ord, CASE ord % 4 WHEN 1 THEN {_template_sql(G.PROMPTS["code"], _PROMPT_COLUMNS)}
       WHEN 2 THEN {_template_sql(G.PROMPTS["qa"], _PROMPT_COLUMNS)}
       ELSE {_template_sql(G.PROMPTS["chat"], _PROMPT_COLUMNS)} END AS prompt
FROM v_pairs""")
def fewshot_prompts(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("chat", "code", "qa", "other")])
    requests = t.pairs().select(
        "ord",
        F.get(kinds, (F.col("ord") % 4).cast("int")).alias("data_type"),
        (F.col("ord") % 30 + 1).alias("count"),
        F.concat(F.lit("topic "), F.col("ord").cast("string")).alias("scenario"),
        F.to_json(F.array(F.struct("instruction", "output"))).alias("examples"),
    )
    return G.render_prompts(requests).select("ord", "prompt")


@query(f"""
SELECT ord, chunk, {_template_sql(G.DOCUMENT_PROMPT, {
    "count": "20", "document": "substr(text, CAST(chunk * 8000 + 1 AS BIGINT), 8000)"})} AS prompt
FROM (SELECT ord, text, unnest(range((length(text) + 7999) // 8000)) AS chunk FROM v_docs
      WHERE length(text) >= 50)""", longs=("chunk",))
def doc_prompts(t: Tables) -> DataFrame:
    prompts = G.document_prompts(t.documents().select("ord", "text"))
    return prompts.select("ord", F.col("chunk").cast("long").alias("chunk"), "prompt")


@query(f"""
SELECT ord, {_template_sql(G.DOCUMENT_PROMPT, {
    "count": "20",
    "document": "CASE WHEN length(text) > 8000 THEN left(text, 8000) || "
                + sql_text(G.TRUNCATED) + " ELSE text END"})} AS prompt
FROM v_docs WHERE length(text) >= 50""")
def doc_prompts_cut(t: Tables) -> DataFrame:
    return G.document_prompts(t.documents().select("ord", "text"), cut=True).select("ord", "prompt")


@query("""
SELECT ord AS reply_id, 0 AS item,
       CASE WHEN ord % 6 <> 5 THEN instruction END AS instruction,
       CASE WHEN ord % 6 <> 5 THEN output END AS output,
       CASE WHEN ord % 6 = 5 THEN instruction END AS question,
       CASE WHEN ord % 6 = 5 THEN output END AS answer
FROM v_pairs WHERE ord % 6 NOT IN (2, 3)""", longs=("item",))
def harvest_json(t: Tables) -> DataFrame:
    return G.harvest(t.replies()).select(
        "reply_id", F.col("item").cast("long").alias("item"), "instruction", "output", "question",
        "answer",
    )


@query("""
SELECT ord AS reply_id, instruction, output FROM v_pairs
WHERE ord % 6 IN (0, 1, 4) AND length(output) > 100""")
def harvest_valid_items(t: Tables) -> DataFrame:
    return G.harvest(t.replies(), min_answer=100).select("reply_id", "instruction", "output")


_HARVEST_SQL = f"""
WITH items AS (SELECT ord, trim(instruction, {WS}) AS u, trim(output, {WS}) AS a
               FROM v_pairs WHERE ord % 6 NOT IN (2, 3)),
kept AS (SELECT * FROM items WHERE length(u) + length(a) BETWEEN 20 AND 8192
         QUALIFY row_number() OVER (PARTITION BY u, a ORDER BY ord) = 1)"""
_HARVESTED = ("SELECT ord, 2 AS n_messages, "
              "'user:' || u || chr(10) || 'assistant:' || a AS chat FROM kept")


@query(f"{_HARVEST_SQL} {_HARVESTED} ORDER BY ord LIMIT 100", longs=("n_messages",))
def harvest_to_chats(t: Tables) -> DataFrame:
    chats = G.harvest_to_chats(t.replies(), target=100)
    return _flat(chats.withColumnRenamed("reply_id", "ord"))


@query(f"{_HARVEST_SQL} {_HARVESTED}", longs=("n_messages",))
def harvest_to_chats_all(t: Tables) -> DataFrame:
    return _flat(G.harvest_to_chats(t.replies()).withColumnRenamed("reply_id", "ord"))


@query("""
WITH items AS (SELECT ord, trim(instruction, """ + WS + """) AS u, trim(output, """ + WS + """) AS a
               FROM v_pairs WHERE ord % 6 IN (0, 1, 4) AND length(output) > 10),
kept AS (SELECT DISTINCT u, a FROM items WHERE length(u) + length(a) BETWEEN 15 AND 8192)
SELECT 1000000 AS target, count(*) AS found, 1000000 - count(*) AS shortfall,
       count(*) >= 1000000 AS success FROM kept""", longs=("target",))
def harvest_shortfall(t: Tables) -> DataFrame:
    chats = G.harvest_to_chats(t.replies(), min_length=15, min_answer=10)
    return G.harvest_summary(chats, 1_000_000)


def _routes_sql() -> str:
    def rows(entries):
        return "[" + ", ".join(f"{{'id': {sql_text(i)}, 'name': {sql_text(n)}}}"
                               for i, n in entries) + "]"

    parts = []
    for keywords, entries in terms.ROUTES:
        test = " OR ".join(f"contains(lower(text), {sql_text(k)})" for k in keywords)
        parts.append(f"CASE WHEN {test} THEN {rows(entries)} ELSE [] END")
    parts.append(rows(terms.DEFAULT_ROUTES))
    joined = " || ".join(f"({p})" for p in parts)
    return f"""
WITH found AS (SELECT ord, {joined} AS ds FROM v_docs),
numbered AS (SELECT ord, generate_subscripts(ds, 1) AS rank, unnest(ds) AS d FROM found)
SELECT ord, rank, d.id AS id, d.name AS name FROM numbered WHERE rank <= {terms.ROUTE_LIMIT}"""


@query(_routes_sql())
def dataset_routing(t: Tables) -> DataFrame:
    described = t.documents().select("ord", F.col("text").alias("description"))
    routed = G.route_datasets(described)
    return routed.withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH prefixes(variant, prefix) AS (VALUES {", ".join(
    f"({i}, {sql_text(p)})" for i, p in enumerate(terms.QUESTION_PREFIXES))}),
variants AS (SELECT p.ord * {len(terms.QUESTION_PREFIXES)} + variant AS ord,
                    CASE WHEN variant = 0 THEN instruction
                         ELSE trim(prefix || instruction, {WS}) END AS instruction, output
             FROM v_pairs p, prefixes)
SELECT ord, instruction, output FROM variants
QUALIFY row_number() OVER (PARTITION BY left(instruction, 30) ORDER BY ord) = 1""")
def variant_expand(t: Tables) -> DataFrame:
    return G.expand_variants(t.pairs()).select("ord", "instruction", "output")


def _swaps(name: str, source: str, rounds: list[tuple[int, int, int]]) -> str:
    """CTEs that apply the rounds to column ``x``, a number below ``n``; the last is ``name``."""
    out = []
    for i, (k, a, b) in enumerate(rounds):
        last = i == len(rounds) - 1
        out.append(f"""
{name if last else f"{name}{i}"} AS (
    SELECT ord, pos, n, CASE WHEN ((m * m) % {G.PRIME} // 16384) % 2 = 1 THEN y ELSE x END AS x
    FROM (SELECT *, (greatest(x, y) % {G.PRIME} * {a} + {b}) % {G.PRIME} AS m
          FROM (SELECT *, ({k} % n - x + n) % n AS y FROM {source})))""")
        source = f"{name}{i}"
    return ",".join(out)


@query(f"""
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS pos, count(*) OVER () AS n
                FROM v_pairs),
places AS (SELECT ord, pos, n, pos AS x FROM ranked),{
    _swaps("place", "places", G.swap_rounds(17)[::-1])},
following AS (SELECT ord, pos, n, (x + 1) % n AS x FROM place),{
    _swaps("partner", "following", G.swap_rounds(17))}
SELECT a.ord AS ord_a, b.ord AS ord_b, a.instruction AS "user", b.output AS assistant
FROM partner p JOIN ranked a ON a.pos = p.pos JOIN ranked b ON b.pos = p.x
WHERE a.instruction <> b.instruction OR a.output <> b.output""")
def mix_pairs(t: Tables) -> DataFrame:
    return G.mix_pairs(t.pairs(), seed=17)
