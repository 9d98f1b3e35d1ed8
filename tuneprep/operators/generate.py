"""Generation planning and reply harvesting; the model call itself happens elsewhere."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.harvest import reply_items
from tuneprep.functions.text import contains_any, fill_template, let, once, strip
from tuneprep.operators.clean import CleanOptions, cap_first, clean, dedup_prefix
from tuneprep.operators.formats import to_messages
from tuneprep.operators.ranking import exact_rank, with_ord_bucket
from tuneprep.rules import terms
from tuneprep.schema import ANY_RECORD
from tuneprep.session import checkpointed

BATCH = 30
DOCUMENT_BATCH = 20
MIN_DOCUMENT = 50
# Default size of a document window.
WINDOW_CHARS = 8000
# Fixed value: text that marks a cut document.
TRUNCATED = "\n...(文档已截断)"

# Our own prompt wording; pass other templates to render_prompts to replace it.
PROMPTS = {
    "chat": "Write {count} chat training examples in the same JSON shape as the samples.\n"
            "Scenario: {scenario}\nSamples:\n{examples}\n"
            "Vary topic and difficulty. Answer with a JSON array only.",
    "code": "Write {count} programming training examples in the same JSON shape as the samples.\n"
            "Scenario: {scenario}\nSamples:\n{examples}\n"
            "Code must run. Cover writing, debugging and explaining. Answer with a JSON array only.",
    "qa": "Write {count} question-answer training examples in the same JSON shape as the samples.\n"
          "Scenario: {scenario}\nSamples:\n{examples}\n"
          "Answers must be factual. Answer with a JSON array only.",
}
DEFAULT_PROMPT = "chat"
DOCUMENT_PROMPT = (
    "Read the document and write {count} question-answer pairs about it.\n"
    "Document:\n{document}\n"
    "Answer with a JSON array of objects with the keys instruction and output only."
)

#: Modulus of the hash in ``swapped``; products of two numbers below it fit into a BIGINT.
PRIME = (1 << 31) - 1


def batch_plan(requests: DataFrame, target: str = "target_count", batch: int = BATCH) -> DataFrame:
    """One row per model call: batch number and how many rows it should ask for."""
    size = F.least(F.lit(batch), F.col(target))
    batches = F.ceil(F.col(target) / size).cast("int")
    return (
        requests.filter(F.col(target) > 0)
        .withColumn("batches", batches)
        .withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
        .withColumn("count", F.least(size, F.col(target) - F.col("batch") * size).cast("long"))
    )


def render_prompts(requests: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Add ``prompt`` from data_type, count, scenario and examples; unknown types use chat."""
    templates = templates or PROMPTS
    values = {n: F.col(n) for n in ("count", "scenario", "examples")}
    default = fill_template(templates[DEFAULT_PROMPT], values)
    prompt = default
    for kind, template in templates.items():
        if kind != DEFAULT_PROMPT:
            prompt = F.when(F.col("data_type") == kind, fill_template(template, values)) \
                .otherwise(prompt)
    return requests.withColumn("prompt", prompt)


def document_prompts(docs: DataFrame, text: str = "text", count: int = DOCUMENT_BATCH,
                     template: str = DOCUMENT_PROMPT, max_chars: int = WINDOW_CHARS,
                     cut: bool = False) -> DataFrame:
    """Prompts for documents of at least 50 characters, one per window of ``max_chars``.

    Adds ``chunk`` (from 0) and ``prompt``; every character of a document is in one prompt. With
    ``cut`` a document has one prompt, and a longer one is marked as cut after ``max_chars``.
    """
    body = F.col(text)
    long_enough = docs.filter(F.length(body) >= MIN_DOCUMENT)
    if cut:
        shown = F.when(F.length(body) > max_chars, F.concat(
            F.substring(body, 1, max_chars), F.lit(TRUNCATED))).otherwise(body)
        rows = long_enough.withColumn("chunk", F.lit(0)).withColumn("_shown", shown)
    else:
        chunks = F.sequence(F.lit(0), ((F.length(body) - 1) / max_chars).cast("int"))
        rows = long_enough.withColumn("chunk", F.explode(chunks)).withColumn(
            "_shown", F.substring(body, F.col("chunk") * max_chars + 1, F.lit(max_chars)))
    prompt = fill_template(template, {"count": F.lit(count), "document": F.col("_shown")})
    return rows.withColumn("prompt", prompt).drop("_shown")


def harvest(replies: DataFrame, text: str = "text", keep: str = "reply_id",
            validate: bool = False, min_answer: int | None = None,
            single: bool = False) -> DataFrame:
    """One row per record found in a reply, with its position and parsed fields.

    ``validate`` keeps items that have both instruction and output (and, with ``min_answer``,
    an output longer than that); ``single`` also takes replies that are one object. Only replies
    with a brace reach the Python worker.
    """

    def parse(item: Column) -> Column:
        return F.from_json(item, ANY_RECORD, {"mode": "PERMISSIVE"})

    items = (
        replies.filter(F.contains(F.col(text), F.lit("{")))
        .select(keep, F.posexplode(reply_items(F.col(text), single)).alias("item", "json"))
        .select(keep, "item", once(F.col("json"), parse).alias("r"))
        .select(keep, "item", "r.*")
    )
    if validate or min_answer is not None:
        items = items.filter(F.col("instruction").isNotNull() & F.col("output").isNotNull())
    if min_answer is not None:
        items = items.filter(F.length("output") > min_answer)
    return items


def harvest_to_chats(replies: DataFrame, target: int | None = None, text: str = "text",
                     keep: str = "reply_id", min_length: int = 20, max_length: int = 8192,
                     min_answer: int | None = None) -> DataFrame:
    """Harvest, convert to messages, clean and cap; rows are ordered by (reply, position).

    The harvested rows are written once (a reliable checkpoint), so replies are parsed once.
    """
    items = checkpointed(harvest(replies, text, keep, min_answer=min_answer))
    order = (keep, "item")
    opts = CleanOptions(min_length=min_length, max_length=max_length)
    chats = clean(to_messages(items, keep=list(order)), opts, order)
    if target is None:
        return chats
    return cap_first(chats, target, *order)


def harvest_summary(chats: DataFrame, target: int) -> DataFrame:
    """One row: wanted and found chats, what is missing, and whether there are enough."""
    return chats.agg(F.count(F.lit(1)).alias("found")).select(
        F.lit(target).cast("long").alias("target"), "found",
        F.greatest(F.lit(target) - F.col("found"), F.lit(0)).cast("long").alias("shortfall"),
        (F.col("found") >= target).alias("success"))


def route_datasets(requests: DataFrame, description: str = "description",
                   limit: int = terms.ROUTE_LIMIT) -> DataFrame:
    """Candidate data sets per description: keyword routes, then the defaults, then the cap."""
    def rows(entries: list[tuple[str, str]]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"))
                         for i, n in entries])

    none = F.array().cast("array<struct<id:string,name:string>>")
    found = let(F.lower(F.col(description)), lambda text: F.slice(F.concat(
        *[F.when(contains_any(text, keywords), rows(entries)).otherwise(none)
          for keywords, entries in terms.ROUTES],
        rows(terms.DEFAULT_ROUTES),
    ), 1, limit))
    kept = [c for c in requests.columns if c != description]
    return requests.select(*kept, F.posexplode_outer(found).alias("rank", "d")).select(
        *kept, F.col("rank") + 1, "d.id", "d.name"
    ).toDF(*kept, "rank", "id", "name")


def expand_variants(rows: DataFrame, question: str = "instruction",
                    prefixes: list[str] | None = None, dedup_chars: int | None = 30) -> DataFrame:
    """Every question with every prefix, the original first; then first row per leading text.

    ``ord`` becomes ``ord * len(prefixes) + variant``.
    """
    prefixes = prefixes or terms.QUESTION_PREFIXES
    choices = F.array(*[F.lit(p) for p in prefixes])
    out = (
        rows.select("*", F.posexplode(choices).alias("variant", "_prefix"))
        .withColumn("ord", F.col("ord") * len(prefixes) + F.col("variant"))
        .withColumn(question, F.when(
            F.col("variant") == 0, F.col(question)
        ).otherwise(strip(F.concat("_prefix", F.col(question)))))
        .drop("_prefix")
    )
    return out if dedup_chars is None else dedup_prefix(out, question, dedup_chars)


def swap_rounds(seed: int, rounds: int = 32) -> list[tuple[int, int, int]]:
    """Constants of ``swapped``'s rounds: a mirror point, and a factor and a term of a hash."""
    numbers = random.Random(seed)
    return [(numbers.getrandbits(60), 1 + numbers.getrandbits(30), numbers.getrandbits(30))
            for _ in range(rounds)]


def swapped(x: Column, n: Column, rounds: list[tuple[int, int, int]]) -> Column:
    """A permutation of the numbers below ``n`` (swap-or-not); reversed rounds give its inverse.

    A round pairs each number with its mirror image, and a bit of a hash of the larger of both
    decides whether they change places. It is one to one for every ``n``, without cycles to walk.
    """
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a"),
                              F.lit(b).cast("long").alias("b")) for k, a, b in rounds])

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(r["k"], n) - x, n)
        mixed = F.pmod(F.pmod(F.greatest(x, other), F.lit(PRIME)) * r["a"] + r["b"], F.lit(PRIME))
        bit = F.pmod(F.shiftright(F.pmod(mixed * mixed, F.lit(PRIME)), 14), F.lit(2))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(keys, x.cast("long"), turn)


def mix_pairs(rows: DataFrame, seed: int = 1, target: int | None = None,
              question: str = "instruction", answer: str = "output") -> DataFrame:
    """Each row's question with the answer of another row, chosen by a seeded permutation.

    A pseudo-random order of all rows is closed to a circle, and a row takes the answer of the next
    one: every question and every answer is used once, and with two rows or more none meets its
    own. Pairs of equal rows are left out. Nothing is sorted by a random key; only ids are ranked,
    and pairing and fetching the texts are equi-joins on unique numbers.
    """
    ranked = checkpointed(
        exact_rank(with_ord_bucket(rows.select("ord"), "ord"), [F.col("ord")])
    )
    turns, n = swap_rounds(seed), F.col("n")
    place = swapped(F.col("pos"), n, turns[::-1])
    left = ranked.select(F.col("ord").alias("ord_a"), F.col("pos").alias("pos_a"), "n",
                         F.pmod(place + 1, n).alias("_next")).select(
        "ord_a", "pos_a", swapped(F.col("_next"), n, turns).alias("pos"))
    right = ranked.select(F.col("ord").alias("ord_b"), "pos")

    def text(side: str, own: str, other: str) -> DataFrame:
        return rows.select(F.col("ord").alias(f"ord_{side}"), F.col(question).alias(own),
                           F.col(answer).alias(other))

    pairs = (
        left.join(right, "pos")
        .join(text("a", "user", "_own"), "ord_a")
        .join(text("b", "_other", "assistant"), "ord_b")
        .filter((F.col("user") != F.col("_other")) | (F.col("_own") != F.col("assistant")))
        .select("pos_a", "ord_a", "ord_b", "user", "assistant")
    )
    if target is not None:
        pairs = cap_first(pairs, target, "pos_a")
    return pairs.drop("pos_a")
