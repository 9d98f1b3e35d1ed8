"""Cross-entropy difference of documents under two matched bigram models.

Method: a target and a background model of the same order, smoothing and pruning share one
vocabulary; a token's loss difference depends on the token and its predecessor alone, and their
mean over a document is its score: below zero, the document looks more like the target.

* Vocabulary: every word of all documents, target and background together, by its 64-bit hash;
  with ``vocabulary`` set only the most frequent ones, others are one unknown word. Sentence-like
  marks are not split off.
* Counts cover every token of every document. Target: the documents labelled good; background:
  all others. Both models keep every bigram; with ``max_bigrams`` set they are pruned alike, by one
  limit on their joint count in a fold.
* No document is scored by models that have seen it: texts fall into ``FOLDS`` folds by their hash
  (so exact copies share one), and a fold is scored by models of the next fold's counts.
* Smoothing: absolute discounting of the kept bigrams, the rest of a history's mass backs off to
  unigrams with add-one smoothing. With it each model sums to one over the vocabulary.

The texts of a fold are shuffled once, into chunks of about ``CHUNK_CHARS`` characters. A chunk counts
its words and bigrams and sends them to buckets, by the word a bigram starts with: arrays, each
distinct bigram once. A bucket sums what all chunks sent and answers each of them, in the order it
was asked: the next fold's counts of its words, and of those bigrams that this fold has at all. The
chunk then scores its texts. A word of the ``frequent`` list has its bigrams in ``SPREAD`` buckets, so
none is much larger than others; the list comes from a sample, and decides on places alone.

Defined results: a null or empty text has no tokens and null scores; a repeated row counts and is
scored each time; several labels of one document are read as target if one is; without target or
background documents the models are uniform; an empty table gives an empty table; other columns
are ignored. The rows of one document id (other than null) are in one chunk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import plain_columns

UNKNOWN = 0
BEGIN = 1
FIRST = 2
FLUSH = 400_000
FOLDS = 2
CHUNK_CHARS = 10_000_000
BUCKET_CHARS = 12_000_000
SPREAD = 32             # buckets of a frequent word
SAMPLE = 2_000          # documents in which frequent words are looked for

SMALL = 11              # counts below it go as one byte a pair

ASKED = ("bucket int, chunk int, fold int, words array<bigint>, sizes array<int>, next array<bigint>, "
         "counts array<tinyint>, more_t array<bigint>, more_b array<bigint>")
ANSWER = ("chunk int, bucket int, size bigint, total_t bigint, total_b bigint, counts array<tinyint>, "
          "more_t array<bigint>, more_b array<bigint>, lost_t array<double>, lost_b array<double>")


@dataclass(frozen=True)
class ModelOptions:
    """Size bounds of both models (``None``: everything is kept), the discount, and the number of
    words that are spread over buckets; the last has no influence on the result."""

    vocabulary: int | None = None
    max_bigrams: int | None = None
    discount: float = 0.75
    frequent: int = 200


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def top_words(docs: DataFrame, limit: int) -> list[str]:
    """The most frequent words; equal counts in the order of the words."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(seen), "n": list(seen.values())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text))
                if len(seen) > FLUSH:
                    yield rows()
        if seen:
            yield rows()

    counts = docs.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(limit).collect()]


def hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False).view(np.int64)


def encoded(text: str | None, known: np.ndarray | None) -> np.ndarray:
    """Hashes of the words; ``UNKNOWN`` for those outside ``known`` (sorted hashes), if given."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    tokens = hashes(words)
    if known is None:
        return tokens
    return np.where(np.isin(tokens, known), tokens, UNKNOWN)


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


@dataclass(frozen=True)
class Places:
    """Where words and bigrams are summed: ``buckets`` of them, and the frequent words (sorted)."""

    buckets: int
    frequent: np.ndarray

    def home(self, words: np.ndarray) -> np.ndarray:
        x = words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.buckets)).astype(np.int64)

    @property
    def spread(self) -> int:
        return min(SPREAD, self.buckets)


class Bigrams:
    """The distinct words and bigrams of a chunk's texts, in the order of their buckets.

    Entries are (bucket, word) pairs: one per word, ``spread`` per frequent word. Bigrams follow the
    entry they start with. How often a word ends a text is told at its home; with the bigrams that
    start with it, this gives the word's own count.
    """

    def __init__(self, texts: list[str | None], known: np.ndarray | None, places: Places):
        tokens = [encoded(t, known) for t in texts]
        self.lengths = np.array([len(k) for k in tokens], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *tokens])
        del tokens
        self.words, ids = np.unique(np.append(flat, BEGIN), return_inverse=True)
        n, begin, self.token = len(self.words), ids[-1], ids[:-1]
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = begin
        pairs, self.where = np.unique(before * n + self.token, return_inverse=True)
        home = places.home(self.words)
        hot = np.isin(self.words, places.frequent)
        shift = np.arange(places.spread)
        spread = (home[hot][:, None] + shift) % places.buckets * n + np.flatnonzero(hot)[:, None]
        keys = np.sort(np.concatenate([(home * n + np.arange(n))[~hot], spread.ravel()]))
        self.entry_bucket, self.entry_word = keys // n, keys % n
        self.at_home = home[self.entry_word] == self.entry_bucket
        first, second = pairs // n, pairs % n
        salt = np.where(hot[first], places.home(self.words[second] ^ 0x5BD1E995) % places.spread, 0)
        entry = np.searchsorted(keys, (home[first] + salt) % places.buckets * n + first)
        self.order = np.argsort(entry, kind="stable")
        self.entry, self.first, self.second = entry[self.order], first[self.order], second[self.order]

    def by_side(self, target: np.ndarray) -> list[np.ndarray]:
        """Target and background counts: of the texts that end with an entry's word, of the bigrams."""
        side = np.repeat(target, self.lengths)
        full = self.lengths > 0
        ends = self.token[np.cumsum(self.lengths)[full] - 1]
        out = [np.bincount(ends[target[full] == k], minlength=len(self.words))[self.entry_word]
               * self.at_home for k in (True, False)]
        return out + [np.bincount(self.where[side == k], minlength=len(self.order))[self.order]
                      for k in (True, False)]


def packed(t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One byte for each two counts; -1 if one of them is not small, which go in lists of their own."""
    return np.where((t < SMALL) & (b < SMALL), t * SMALL + b, -1).astype(np.int8)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    code = flat(rows["counts"]).astype(np.int64)
    t, b = code // SMALL, code % SMALL
    t[code < 0], b[code < 0] = flat(rows["more_t"]), flat(rows["more_b"])
    return t, b


def kinds(*sizes: np.ndarray) -> np.ndarray:
    """The kind (0, 1, ...) of each value of lists that hold ``sizes[kind]`` values of every kind."""
    return np.repeat(np.tile(np.arange(len(sizes)), len(sizes[0])), np.stack(sizes, 1).ravel())


def arrow_schema(columns: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32()),
             "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
             "array<tinyint>": pa.list_(pa.int8())}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, columns.split(", "))])


def arrays(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values as lists that end at ``ends``."""
    return pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(values, kind))


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a column of lists."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def asked(rows: pa.Table, known: np.ndarray | None, places: Places) -> pa.Table:
    """What a chunk (documents and labels) asks of every bucket."""
    docs, good = rows.filter(pc.invert(rows["good"])), rows.filter(rows["good"])["doc_id"]
    have = Bigrams(docs["text"].to_pylist(), known, places)
    n = places.buckets if have.lengths.sum() else 0
    if not n:
        return arrow_schema(ASKED).empty_table()
    ends_t, ends_b, t, b = have.by_side(
        pc.is_in(docs["doc_id"], good).to_numpy(zero_copy_only=False))
    buckets = np.concatenate([2 * have.entry_bucket, 2 * have.entry_bucket[have.entry] + 1])
    order = np.argsort(buckets, kind="stable")
    t, b = np.concatenate([ends_t, t])[order], np.concatenate([ends_b, b])[order]
    code = packed(t, b)
    large = code < 0

    def ends(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(values, np.arange(n), "right")

    words, more = ends(have.entry_bucket), ends(buckets[order][large] // 2)
    return pa.table({
        "bucket": pa.array(np.arange(n), pa.int32()),
        "chunk": pa.array(np.full(n, rows["chunk"][0].as_py()), pa.int32()),
        "fold": pa.array(np.full(n, rows["fold"][0].as_py()), pa.int32()),
        "words": arrays(have.words[have.entry_word], words, pa.int64()),
        "sizes": arrays(np.bincount(have.entry, minlength=len(have.entry_word)), words, pa.int32()),
        "next": arrays(have.words[have.second], np.searchsorted(have.entry, words), pa.int64()),
        "counts": arrays(code, ends(buckets[order] // 2), pa.int8()),
        "more_t": arrays(t[large], more, pa.int64()), "more_b": arrays(b[large], more, pa.int64())})


class Summed:
    """A bucket's words and bigrams with the counts of all chunks, by fold and side."""

    def __init__(self, rows: pa.Table):
        n_words = pc.list_value_length(rows["words"]).to_numpy()
        n_next = pc.list_value_length(rows["next"]).to_numpy()
        folds = rows["fold"].to_numpy()
        self.words, self.word = np.unique(flat(rows["words"]), return_inverse=True)
        first = np.repeat(self.word, flat(rows["sizes"]))
        after, second = np.unique(flat(rows["next"]), return_inverse=True)
        pairs, self.pair = np.unique(first * max(1, len(after)) + second, return_inverse=True)
        self.first = pairs // max(1, len(after))
        word_fold, pair_fold = np.repeat(folds, n_words), np.repeat(folds, n_next)
        kind, counts = kinds(n_words, n_next), dict(zip("tb", unpacked(rows)))
        self.ends, self.n = {}, {}
        for k in range(FOLDS):
            for side, n in counts.items():
                self.ends[k, side] = self._sum(self.word, n[kind == 0], word_fold == k, len(self.words))
                self.n[k, side] = self._sum(self.pair, n[kind == 1], pair_fold == k, len(pairs))
        self.word_ends, self.pair_ends = np.cumsum(n_words), np.cumsum(n_next)

    @staticmethod
    def _sum(at: np.ndarray, n: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at[rows], n[rows], size).astype(np.int64)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.first, values, len(self.words))


def answers(rows: pa.Table, places: Places, limits: list[int], discount: float) -> pa.Table:
    """A bucket's answer to every chunk: the next fold's counts of what the chunk asked for.

    ``lost`` is the part of a word's bigram counts that goes to unigrams, where it has bigrams.
    """
    have = Summed(rows)
    bucket = rows["bucket"][0].as_py()
    token = have.words != BEGIN
    size = int((token & (places.home(have.words) == bucket)).sum())
    kept = {(k, side): np.where(have.n[k, "t"] + have.n[k, "b"] >= limits[k], n, 0)
            for (k, side), n in have.n.items()}
    h = {key: have.by_word(n).astype(np.int64) for key, n in have.n.items()}
    lost = {key: h[key] - have.by_word(np.maximum(n - discount, 0.0)) for key, n in kept.items()}
    out = []
    for i, (chunk, fold) in enumerate(zip(rows["chunk"].to_pylist(), rows["fold"].to_pylist())):
        word = have.word[have.word_ends[i - 1] if i else 0:have.word_ends[i]]
        pair = have.pair[have.pair_ends[i - 1] if i else 0:have.pair_ends[i]]
        row = {"chunk": chunk, "bucket": bucket, "size": size}
        counts = []
        for side in "tb":
            key = (fold + 1) % FOLDS, side
            counts.append(np.concatenate([have.ends[key][word], h[key][word], kept[key][pair]]))
            row[f"total_{side}"] = int((have.ends[key] + h[key])[token].sum())
            row[f"lost_{side}"] = lost[key][word[h[key][word] > 0]]
        row["counts"] = packed(*counts)
        row["more_t"], row["more_b"] = (n[row["counts"] < 0] for n in counts)
        out.append(row)
    schema = arrow_schema(ANSWER)
    return pa.table({name: [row[name] for row in out] for name in schema.names}, schema)


def joint_counts(rows: pa.Table) -> pa.Table:
    """(fold, n, bigrams): how many bigrams of a bucket have the joint count ``n`` in a fold."""
    have = Summed(rows)
    found = [(k, *np.unique(n[n > 0], return_counts=True))
             for k, n in ((k, have.n[k, "t"] + have.n[k, "b"]) for k in range(FOLDS))]
    return pa.table({"fold": pa.array(np.concatenate([np.full(len(n), k) for k, n, _ in found]), pa.int32()),
                     "n": pa.array(np.concatenate([n for _, n, _ in found]), pa.int64()),
                     "bigrams": pa.array(np.concatenate([x for *_, x in found]), pa.int64())})


def pruning_limit(counts: DataFrame, most: int) -> int:
    """The smallest joint count ``n`` from which on at most ``most`` bigrams are kept."""
    exact = F.least(F.col("n"), F.lit(1 << 20))
    size = F.when(exact < 1024, exact).otherwise(F.lit(1024) * F.floor(exact / 1024))
    steps = counts.groupBy(size.alias("size")).agg(F.sum("bigrams").alias("n")).collect()
    limit, total = (1 << 20) + 1, 0
    for row in sorted(steps, key=lambda r: -r["size"]):
        total += row["n"]
        if total > most:
            return limit
        limit = row["size"]
    return limit


def losses(have: Bigrams, replies: pa.Table, size: int | None, discount: float) -> list[np.ndarray]:
    """Target and background loss of every token of a chunk: negative natural logarithms."""
    replies = replies.sort_by("bucket")
    size = FIRST + (pc.sum(replies["size"]).as_py() if size is None else size)
    buckets = replies["bucket"].to_numpy()
    n_words, n_next = (np.bincount(x, minlength=len(buckets))
                       for x in (have.entry_bucket, have.entry_bucket[have.entry]))
    kind = kinds(n_words, n_words, n_next)
    out = []

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(have.entry_word, values, len(have.words))

    for side, counts in zip("tb", unpacked(replies)):
        h = counts[kind == 1]
        lost = np.zeros(len(h))
        lost[h > 0] = flat(replies[f"lost_{side}"])
        lost, ends, h = by_word(lost), by_word(counts[kind == 0]), by_word(h)
        unigram = (h + ends + 1) / float(pc.sum(replies[f"total_{side}"]).as_py() + size)
        rest = np.where(h > 0, lost / np.maximum(h, 1), 1.0)
        kept = np.maximum(counts[kind == 2] - discount, 0.0) / np.maximum(h, 1)[have.first]
        loss = np.empty(len(have.order))
        loss[have.order] = -np.log(kept + rest[have.first] * unigram[have.second])
        out.append(loss[have.where])
    return out


def score(docs: DataFrame, labels: DataFrame, options: ModelOptions = ModelOptions(),
          doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, n_tokens, mean losses of both models, their difference.

    ``labels`` (doc_id, label): the documents with label 1 are the target.
    """
    base = plain_columns(docs, {"doc_id": doc_id, "text": text})
    kind = base.schema["doc_id"].dataType
    context = docs.sparkSession.sparkContext
    n_docs, chars = base.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    words = None if options.vocabulary is None else top_words(base, options.vocabulary)
    known = context.broadcast(None if words is None else np.sort(hashes(words)))
    sample = base.sample(min(1.0, SAMPLE / max(1, n_docs)), 1)
    places = Places(1 + chars // BUCKET_CHARS, np.sort(hashes(top_words(sample, options.frequent))))
    chunks = 1 + chars // (CHUNK_CHARS * FOLDS)

    def chunk_of(key: Column) -> Column:
        return (F.pmod(F.xxhash64(key), F.lit(chunks)) * FOLDS + F.col("fold")).cast("int")

    rows = base.withColumn("fold", fold_of(F.col("text"))).select(
        chunk_of(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")))
        .alias("chunk"), "fold", "doc_id", "text", F.lit(False).alias("good"))
    good = plain_columns(labels, {"id": doc_id, "label": label}).where("label = 1").select(
        F.col("id").cast(kind).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    good = good.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).select(
        chunk_of(F.xxhash64("doc_id")).alias("chunk"), "fold", "doc_id",
        F.lit(None).cast("string").alias("text"), F.lit(True).alias("good"))
    parts = rows.unionByName(good).repartition(chunks * FOLDS, "chunk")
    sent = parts.groupBy("chunk").applyInArrow(
        lambda table: asked(table, known.value, places), ASKED).repartition(places.buckets, "bucket")
    limits = [0] * FOLDS
    if options.max_bigrams is not None:
        counts = sent.groupBy("bucket").applyInArrow(joint_counts, "fold int, n bigint, bigrams bigint")
        limits = [pruning_limit(counts.where(F.col("fold") == k), options.max_bigrams)
                  for k in range(FOLDS)]
    replies = sent.groupBy("bucket").applyInArrow(
        lambda table: answers(table, places, limits, options.discount), ANSWER).repartition(
            chunks * FOLDS, "chunk")
    size = None if words is None else len(words)

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        table = table.filter(pc.invert(table["good"]))
        have = Bigrams(table["text"].to_pylist(), known.value, places)
        mean = [np.zeros(len(table))] * 2
        if have.lengths.sum():
            row = np.repeat(np.arange(len(table)), have.lengths)
            mean = [np.bincount(row, x, len(table)) / np.maximum(have.lengths, 1)
                    for x in losses(have, found, size, options.discount)]
        target, background = (pa.array(x, pa.float64(), mask=have.lengths == 0) for x in mean)
        return pa.table({"doc_id": table["doc_id"], "n_tokens": have.lengths, "target_loss": target,
                         "background_loss": background, "difference": pc.subtract(target, background)})

    return parts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        run, f"doc_id {kind.simpleString()}, n_tokens bigint, target_loss double, "
             "background_loss double, difference double")
