"""Benchmark decontamination over a distributed positional inverted index.

Method: store the postings (term, row, position) of the training tokens; for every window of a
benchmark item take its two rarest terms by corpus frequency, shift their posting lists by the
terms' places in the item, and intersect them. What is left is few, and is held against the
document's words: a run of equal words as long as a window is an exact match; a stretch that has
nearly all words of the window within ``slop`` extra places is a proximity match.

Postings of terms that no item has are never read, so they are not stored. The index is written
next to its documents, without a shuffle; only the shifted postings of rare terms are shuffled,
and the texts of the documents that are left. Terms and anchors are broadcast where their counted
number is small (``BROADCAST_ROWS``); otherwise they join by shuffle.

Defined results: null and empty texts have no words; an item without words never matches, an item
of fewer words than a window is one window; repeated rows get equal rows; null item ids are left
out of the lists; empty tables give an empty or an all-clean result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, let, plain_columns, with_default

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000
END = 0

NO_HITS = "array<struct<item:string,start:int,stop:int,exact:boolean>>"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """Words in their own case; empty for empty and null texts."""
    trimmed = F.regexp_replace(with_default(text), f"^{SEPARATORS}", "")
    return let(F.split(trimmed, SEPARATORS), lambda w: F.filter(w, lambda x: x != ""))


def words_of(text: Column) -> Column:
    return F.transform(raw_words(text), lower_ascii)


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, with_default(text))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a counted small table; leave a larger one to a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, words, size): items with words; equal items stay apart by their ids."""
    base = plain_columns(items, {"item_id": item_id, "text": text})
    return frozen(base.select("item_id", words_of(F.col("text")).alias("words"))
                  .where(F.size("words") > 0).distinct()
                  .withColumn("item", F.xxhash64("item_id", "words")), "items")


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Postings (term, row, pos) of the words that occur in ``terms(word, term)``.

    Each row ends with an empty word, the term ``END``; its position is the row's length.
    """
    base = plain_columns(docs, {"doc_id": doc_id, "text": text})
    tokens = (base.select(row_key(F.col("doc_id"), F.col("text")).alias("row"),
                          F.posexplode(F.array_append(raw_words(F.col("text")), F.lit("")))
                          .alias("pos", "raw"))
              .select("row", "pos", lower_ascii(F.col("raw")).alias("word")))
    return frozen(tokens.join(_small(terms), "word").select("term", "row", "pos"), "index")


def anchor_pairs(items: DataFrame, index: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """Per window its two rarest places (equal ones for a one-word item), with role and term.

    A window with a term that no document has cannot match and gets no anchors.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    places = (items.select("item", F.size("words").alias("size"),
                           F.posexplode("words").alias("at", "word"))
              .join(terms, "word").join(counts, "term"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - (window - 1)),
                        F.least(F.col("at"), F.greatest(F.col("size") - window, F.lit(0))))
    rarest = Window.partitionBy("item", "start").orderBy("df", "at")
    pairs = (places.withColumn("start", F.explode(starts))
             .withColumn("rank", F.row_number().over(rarest))
             .withColumn("known", F.count("*").over(Window.partitionBy("item", "start")))
             .where((F.col("known") == F.least(F.col("size"), F.lit(window)))
                    & (F.col("rank") <= 2)))
    grouped = pairs.groupBy("item", "start").agg(
        F.min_by("at", "rank").alias("p1"), F.max_by("at", "rank").alias("p2"),
        F.min_by("term", "rank").alias("t1"), F.max_by("term", "rank").alias("t2"))
    role = F.explode(F.array(
        F.struct(F.lit(1).alias("role"), F.col("t1").alias("term"), F.col("p1").alias("at")),
        F.struct(F.lit(2).alias("role"), F.col("t2").alias("term"), F.col("p2").alias("at"))))
    return frozen(grouped.groupBy("item", "p1", "p2", "t1", "t2").agg(
        F.min("start").alias("start")).withColumn("r", role).select(
            "item", "start", "p1", "p2", "r.*"), "anchors")


def intersect(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """(row, item, start, diagonal) where both shifted posting lists of a pair meet.

    The diagonal is the document position of the item's first word. Lists meet when their
    diagonals differ by at most ``slop``: the rarer list is entered under each such shift.
    """
    shifted = index.join(_small(anchors), "term").select(
        "row", "item", "start", "p1", "p2", "role", (F.col("pos") - F.col("at")).alias("diagonal"))
    shifts = F.when(F.col("role") == 2, F.array(F.lit(0))).otherwise(
        F.array(*[F.lit(k) for k in range(-slop, slop + 1)]))
    met = (shifted.withColumn("shift", F.explode(shifts))
           .withColumn("diagonal", F.col("diagonal") + F.col("shift"))
           .groupBy("row", "item", "start", "p1", "p2", "diagonal")
           .agg(F.bit_or("role").alias("roles"),
                F.bit_or(F.when(F.col("shift") == 0, F.col("role")).otherwise(0)).alias("straight"))
           .where("roles = 3"))
    return met.groupBy("row", "item", "start", "diagonal").agg(
        F.max(F.col("straight") == 3).alias("straight"))


def _runs(words: Column, c: Column, window: int) -> Column:
    """Exact runs of one candidate: stretches of equal words at least a window long."""
    size = F.size(c["words"])
    gaps = F.filter(F.sequence(F.lit(0), size), lambda k: (k == size) | ~(
        F.get(words, c["diagonal"] + k).eqNullSafe(F.get(c["words"], k))))
    stretches = let(gaps, lambda g: F.transform(g, lambda x, i: F.struct(
        c["name"].alias("item"),
        (c["diagonal"] + F.coalesce(F.get(g, i - 1) + 1, F.lit(0))).alias("start"),
        (c["diagonal"] + x).alias("stop"), F.lit(True).alias("exact"))))
    return F.filter(stretches, lambda s: s["stop"] - s["start"]
                    >= F.least(size, F.lit(window)))


def _near(words: Column, c: Column, window: int, slop: int, share: float) -> Column:
    """A proximity match of the candidate's window, as an array of at most one stretch."""
    size = F.least(F.size(c["words"]), F.lit(window))
    first = c["diagonal"] + c["start"] - slop
    wanted = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.get(c["words"], c["start"] + k))
    there = F.transform(F.sequence(F.lit(0), size - 1 + 2 * slop), lambda k: F.get(words, first + k))
    found = let(there, lambda t: F.size(F.filter(wanted, lambda x: F.array_contains(t, x))))
    stretch = F.struct(c["name"].alias("item"), F.greatest(first, F.lit(0)).alias("start"),
                       (first + size + 2 * slop).alias("stop"), F.lit(False).alias("exact"))
    return F.when(found >= share * size, F.array(stretch)).otherwise(F.array().cast(NO_HITS))


def _covered(stretches: Column) -> Column:
    """Number of positions inside the stretches."""
    ordered = F.sort_array(F.transform(stretches, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(ordered, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["end"]), F.lit(0))).cast("long")
        .alias("n"), F.greatest(s["stop"], a["end"]).alias("end")), lambda a: a["n"])


def find_matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2,
                 share: float = 0.8, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, matches) of the documents with matches; ``row`` is ``row_key`` of id and text."""
    return search(docs, items, window, slop, share, doc_id, text, item_id, item_text)[1]


def search(docs: DataFrame, items: DataFrame, window: int, slop: int, share: float, doc_id: str,
           text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """The index, and (row, matches) of the documents with matches.

    ``matches``: item, start, stop (word positions, stop exclusive), exact. A window with at least
    ``share`` of its words within ``slop`` places more on either side is a proximity match.
    """
    known = item_words(items, item_id, item_text)
    terms = frozen(known.select(F.explode("words").alias("word")).distinct()
                   .withColumn("term", F.xxhash64("word"))
                   .union(docs.sparkSession.range(1).select(F.lit(""), F.lit(END).cast("bigint"))),
                   "terms")
    index = build_index(docs, terms, doc_id, text)
    anchors = anchor_pairs(known, index, terms, window)
    names = known.select("item", F.col("item_id").cast("string").alias("name"), "words")
    candidates = frozen(intersect(index, anchors, slop).join(names, "item").groupBy("row").agg(
        F.collect_list(F.struct("name", "words", "start", "diagonal", "straight"))
        .alias("candidates")), "candidates")
    base = plain_columns(docs, {"doc_id": doc_id, "text": text})
    keyed = base.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    # Texts are shuffled for it at every size; Spark adds a runtime filter on large inputs.
    found = keyed.join(candidates.hint("merge"), "row").select("row", let(words_of(F.col("text")), lambda w: (
        F.array_distinct(F.flatten(F.transform("candidates", lambda c: let(
            F.when(c["straight"], _runs(w, c, window)).otherwise(F.array().cast(NO_HITS)),
            lambda runs: F.when(F.size(runs) > 0, runs).otherwise(
                _near(w, c, window, slop, share)))))))).alias("matches"))
    return index, found.where(F.size("matches") > 0).dropDuplicates(["row"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2,
                  share: float = 0.8, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: words, hit words, items by exact and by proximity matches."""
    index, found = search(docs, items, window, slop, share, doc_id, text, item_id, item_text)
    found = frozen(found, "matches")
    exact = F.filter("matches", lambda m: m["exact"])
    names = F.filter(F.transform(exact, lambda m: m["item"]), lambda x: x.isNotNull())
    ids = F.sort_array(F.array_distinct(names))
    summed = found.select(
        "row", _covered(exact).alias("n_hit"), ids.alias("ids"),
        F.size(F.array_distinct(F.transform(F.filter("matches", lambda m: ~m["exact"]),
                                            lambda m: m["item"]))).cast("long").alias("n_near"))
    none = F.array().cast("array<string>")
    lengths = index.where(F.col("term") == END).groupBy("row").agg(
        F.max("pos").cast("long").alias("n_words"))
    base = plain_columns(docs, {"doc_id": doc_id, "text": text})
    return (base.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"))
            .join(lengths, "row").join(summed, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")))


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                    text: str = "text", **options) -> DataFrame:
    """The rows without an exact match, with all their columns."""
    found = find_matches(docs, items, doc_id=doc_id, text=text, **options)
    hit = frozen(found.where(F.exists("matches", lambda m: m["exact"]))
                 .select(F.col("row").alias("_hit")), "contaminated")
    keyed = docs.withColumn("_row", row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    return keyed.join(hit.hint("merge"), keyed["_row"] == hit["_hit"], "left_anti").drop("_row")
