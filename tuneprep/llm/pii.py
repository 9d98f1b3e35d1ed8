"""Personal data: base patterns, and further spans chosen by boosted trees.

Method: generators with high recall propose spans, which may overlap; boosted trees score them by
features of their format and context; thresholds calibrated on held-out candidates choose spans.
The trees learn from the base patterns: a candidate on a base span of its kind is positive, and so
is its copy rewritten into an obfuscated form. A candidate on no base span of its kind but with
the form of its kind (``_plausible``) is what the trees may add; it has no label. Any other is negative. The
trees are fitted on at most ``sample_rows`` candidates, as many of each kind (those with the
smallest hashes); every candidate of every document is then scored. A kind's threshold is the
lowest score from which on at least ``precision`` of all its held-out labelled candidates are
positive; a kind with too few of them gets no further spans.

Each text is read once; what moves afterwards are spans and features. Positions are code points.

Defined results: null and empty texts have no spans; repeated rows get equal spans; with too few
candidates to fit, or an empty table, only base spans remain; other columns are ignored
(``redact`` passes them on).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, let, plain_columns, with_default

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:int,start:int,stop:int>>"

# Base patterns. Possessive repetition and the start conditions do not change what they find;
# they keep the work linear in long runs: a match starts where a run starts or the last one ended.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
AT = r"\s?(?:@|[(\[]\s?at\s?[)\]])\s?"
DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)"
GENERATORS = (
    rf"(?<![\w.%+-])[\w.%+-]++{AT}[\w-]++(?:{DOT}[\w-]++)++",
    r"(?<![0-9.])[0-9]++(?:[.,][0-9]++){3}+",
    r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,18}+(?![0-9])",
    r"(?<![0-9+])(?:\+|00|\()?[0-9](?:[\x20()./-]{0,3}[0-9]){7,15}+(?![0-9])",
)
NEEDED = (r"@|[(\[]\s?at", r"[0-9]", r"[0-9]", r"[0-9]")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CONTEXT = ("mail|contact|write|schreib|écri", r"\bip\b|host|server|addr", "card|visa|credit|pay",
           "phone|tel|call|fax|mobil")
CONTEXT_CHARS = 24


@dataclass(frozen=True)
class PiiOptions:
    """Bound of the fitting sample, size of the ensemble, and the wanted precision."""

    sample_rows: int = 20_000
    min_positive: int = 50
    min_held_out: int = 20
    trees: int = 10
    depth: int = 3
    precision: float = 0.98


def find_all(text: Column, pattern: str) -> Column:
    """All matches: start, stop (code points, exclusive), the match, and the text around it."""
    def located(gaps: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        stops = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, n: F.concat(
            a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
        return let(stops, lambda e: F.transform(found, lambda m, i: F.struct(
            (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("stop"), m.alias("match"),
            F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)).alias("left"),
            F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS)).alias("right"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) == 0, F.array().cast(
            "array<struct<start:int,stop:int,match:string,left:string,right:string>>")).otherwise(
                let(F.split(text, pattern, -1), lambda gaps: located(gaps, found))))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for digit strings whose Luhn sum is a multiple of ten."""
    def weighted(c: Column, i: Column) -> Column:
        return let((F.ascii(c) - 48) * F.when(i % 2 == 1, 2).otherwise(1),
                   lambda x: F.when(x > 9, x - 9).otherwise(x))

    parts = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(parts, weighted), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    """The check that a base match of the kind must pass."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.rlike(match, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == 2:
        return let(digits_of(match), lambda d: F.when(
            F.length(d).between(13, 19), luhn(d)).otherwise(False))
    return F.length(digits_of(match)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, by kind and start."""
    def of_kind(kind: int, pattern: str) -> Column:
        passed = F.filter(find_all(text, pattern), lambda m: _valid(kind, m["match"]))
        return F.transform(passed, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))

    return F.concat(*[of_kind(kind, pattern) for kind, pattern in enumerate(BASE)]).cast(SPANS)


def _number(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def _features(kind: int, m: Column) -> list[Column]:
    """Format of the candidate and the words around it."""
    match, left = m["match"], F.lower(m["left"])
    digits = digits_of(match)
    return [
        F.lit(float(kind)), F.length(match).cast("double"), F.length(digits).cast("double"),
        F.regexp_count(match, F.lit(r"[^0-9]+")).cast("double"),
        F.regexp_count(match, F.lit(DOT)).cast("double"),
        F.length(F.regexp_extract(match, "[0-9]+", 0)).cast("double"),
        _number(F.rlike(match, F.lit(AT))), _number(F.rlike(match, F.lit(r"^(?:\+|00)"))),
        _number(F.rlike(match, F.lit(rf"^{OCTET}(?:[.,]{OCTET}){{3}}$"))),
        _number((F.length(digits) > 0) & luhn(digits)),
        _number(F.rlike(left, F.lit(r"(?:^|\s)$"))),
        _number(F.rlike(m["right"], F.lit(r"^(?:$|[\s.,;])"))),
        *[_number(F.rlike(left, F.lit(words))) for words in CONTEXT],
    ]


def _in_context(kind: int, m: Column) -> Column:
    return F.rlike(F.lower(m["left"]), F.lit(CONTEXT[kind]))


def _plausible(kind: int, m: Column) -> Column:
    """The form of the kind, whether or not a base pattern has it.

    Numbers with commas and digits without a sign are so only after a word of their kind.
    """
    match = m["match"]
    if kind == 0:
        plain = F.regexp_replace(F.regexp_replace(match, AT, "@"), DOT, ".")
        return F.rlike(plain, F.lit(r"@[^@]+\.[A-Za-z]{2,}$"))
    if kind == 1:
        return (F.rlike(match, F.lit(rf"^{OCTET}(?:[.,]{OCTET}){{3}}$"))
                & (~F.contains(match, F.lit(",")) | _in_context(kind, m)))
    if kind == 2:
        return _valid(kind, match)
    signed = F.rlike(match, F.lit(r"^(?:\+|00)"))
    size = F.length(F.regexp_replace(digits_of(match), "^00", ""))
    return size.between(9, 15) & (signed | _in_context(kind, m))


def _rewritten(kind: int, m: Column) -> Column:
    """The match in an obfuscated form."""
    match = m["match"]
    if kind == 0:
        return F.regexp_replace(F.regexp_replace(match, "@", " (at) "), r"\.(?=[^.(]*$)", " (dot) ")
    if kind == 1:
        return F.when(_in_context(kind, m), F.translate(match, ".", ",")).otherwise(match)
    if kind == 2:
        return F.regexp_replace(match, r"[\x20-]", ".")
    bare = _in_context(kind, m) & (F.pmod(F.xxhash64(match), F.lit(2)) == 0)
    return F.when(bare, F.regexp_replace(match, r"^\+", "")).otherwise(
        F.regexp_replace(match, r"^\+", "00"))


def candidates(text: Column) -> Column:
    """Proposed spans of all generators, with their features and those of the rewritten match."""
    def of_kind(kind: int, pattern: str, needed: str) -> Column:
        found = F.transform(find_all(text, pattern), lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"),
            _plausible(kind, m).alias("plausible"), F.array(*_features(kind, m)).alias("x"),
            F.array(*_features(kind, {"match": _rewritten(kind, m), "left": m["left"],
                                      "right": m["right"]})).alias("y")))
        return F.when(F.rlike(text, F.lit(needed)), found).otherwise(F.array()).cast(
            "array<struct<kind:int,start:int,stop:int,plausible:boolean,x:array<double>,"
            "y:array<double>>>")

    return F.concat(*[of_kind(kind, pattern, needed)
                      for kind, (pattern, needed) in enumerate(zip(GENERATORS, NEEDED))])


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, doc_id, text_hash, base, candidates) of every row, written once."""
    base = plain_columns(docs, {"doc_id": doc_id, "text": text})
    value = with_default(F.col("text"))
    return frozen(base.select("doc_id", F.xxhash64(value).alias("text_hash"),
                              base_spans(value).alias("base"), candidates(value).alias("candidates"))
                  .withColumn("row_id", F.monotonically_increasing_id()), "pii-scan")


def scored(scanned: DataFrame, options: PiiOptions) -> DataFrame | None:
    """(row_id, kind, start, stop, free, score, limit) of all candidates; None without a model.

    ``free``: the candidate meets no base span. ``limit`` is its kind's threshold.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = scanned.where(F.size("candidates") > 0).select("row_id", "doc_id", "base", F.explode(
        "candidates").alias("c"))
    free = ~F.exists("base", lambda b: _meets(b, F.col("c")))
    own = F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & _meets(b, F.col("c")))
    labelled = rows.select(
        "row_id", "c.kind", "c.start", "c.stop", array_to_vector("c.x").alias("features"),
        array_to_vector("c.y").alias("rewritten"),
        F.when(own, 1.0).when(~F.col("c.plausible"), 0.0).alias("label"),
        free.alias("free"), F.xxhash64("doc_id", "c.kind", "c.start", "c.stop").alias("order"))
    known = labelled.where(F.col("label").isNotNull())
    # Positive candidates enter twice, as they are and rewritten.
    twice = known.select("kind", "features", "label", "order").unionAll(
        known.where("label = 1").select("kind", F.col("rewritten").alias("features"), "label", "order"))
    each = options.sample_rows // len(KINDS)
    fit = frozen(reduce(DataFrame.unionAll, [
        twice.where((F.col("kind") == kind) & F.expr("pmod(order, 4) > 0")).orderBy(
            "order", "label").limit(each)
        for kind in range(len(KINDS))]).coalesce(1), "pii-sample")
    held = twice.where("pmod(order, 4) = 0")
    seen = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(seen.get(0.0, 0), seen.get(1.0, 0)) < options.min_positive:
        return None
    model = GBTClassifier(maxIter=options.trees, maxDepth=options.depth, seed=7).fit(fit)

    def with_score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("score", vector_to_array("probability")[1])

    # At most 4 kinds times 101 score steps. A positive candidate and its copy count as one.
    share = F.when(F.col("label") == 1, 0.5).otherwise(1.0)
    steps = (with_score(held).groupBy("kind", F.floor(F.col("score") * 100).alias("step"))
             .agg(F.sum(share).alias("n"), F.sum(share * F.col("label")).alias("good")).collect())
    limits = {kind: _threshold([(r["step"], r["n"], r["good"]) for r in steps if r["kind"] == kind],
                               options) for kind in range(len(KINDS))}
    limit = F.get(F.array(*[F.lit(limits[k]) for k in range(len(KINDS))]), F.col("kind"))
    return with_score(labelled).select("row_id", "kind", "start", "stop", "free", "score",
                                       limit.alias("limit"))


def _threshold(steps: list[tuple[int, float, float]], options: PiiOptions) -> float:
    """The lowest score from which on the held-out precision holds; 2 if there is none."""
    best, n, good = 2.0, 0, 0.0
    for step, count, positive in sorted(steps, reverse=True):
        n, good = n + count, good + positive
        if n >= options.min_held_out and good >= options.precision * n:
            best = step / 100
    return best


def find_pii(docs: DataFrame, options: PiiOptions = PiiOptions(), doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash, ``base`` and ``added`` spans (kind, start, stop)."""
    scanned = scan(docs, doc_id, text)
    found = scored(scanned, options)
    if found is None:
        return scanned.select("doc_id", "text_hash", "base", F.array().cast(SPANS).alias("added"))
    chosen = found.where(F.col("free") & (F.col("score") >= F.col("limit"))).groupBy("row_id").agg(
        F.collect_list(F.struct("score", "kind", "start", "stop")).alias("c"))

    def beats(b: Column, a: Column) -> Column:
        rank = lambda x: F.struct((-x["score"]).alias("s"), x["kind"], x["start"], x["stop"])
        return _meets(a, b) & (rank(b) < rank(a))

    best = F.sort_array(F.transform(F.filter("c", lambda a: ~F.exists("c", lambda b: beats(b, a))),
                                    lambda a: F.struct(a["kind"], a["start"], a["stop"])))
    chosen = chosen.select("row_id", F.array_distinct(best.cast(SPANS)).alias("added"))
    return scanned.join(chosen, "row_id", "left").select(
        "doc_id", "text_hash", "base", F.coalesce("added", F.array().cast(SPANS)).alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_report(docs: DataFrame, options: PiiOptions = PiiOptions(), doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Numbers of base spans per kind, their digest, and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find_pii(docs, options, doc_id, text).select(
        "doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of met spans as the name of its first span in brackets."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(
        a["out"].alias("out"), F.greatest(a["at"], s["stop"]).alias("at"))).otherwise(F.struct(
            F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]),
                                       F.get(marks, s["kind"]))).alias("out"),
            s["stop"].alias("at")))
    return F.aggregate(ordered, start, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def redact(docs: DataFrame, options: PiiOptions = PiiOptions(), doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """All rows with all columns; personal data in ``text`` is replaced by its kind.

    Rows with spans are joined on (id, text hash); the others pass unchanged.
    """
    found = (find_pii(docs, options, doc_id, text)
             .withColumn("_spans", F.concat("base", "added")).where(F.size("_spans") > 0)
             .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
             .dropDuplicates(["_id", "_hash"]))
    value = F.col(f"`{text}`")
    keyed = docs.withColumn("_key", F.xxhash64(with_default(value)))
    return (keyed.join(found.hint("merge"), (F.col("_key") == F.col("_hash"))
                       & F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")), "left")
            .withColumn(text, F.when(F.col("_spans").isNull(), value)
                        .otherwise(redacted(value, F.col("_spans"))))
            .select(*[f"`{c}`" for c in docs.columns]))
