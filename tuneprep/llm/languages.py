"""Language identification by rank-order profiles of character n-grams.

Texts are lower-cased; runs of letters are words, joined and enclosed by one separator, and the
n-grams are all runs of one to three characters that do not cross a separator. A language's
profile ranks its ``top`` most frequent n-grams over all learned texts, a document's profile its
own. The out-of-place distance adds up, over the document's n-grams, how far their ranks lie
apart; an n-gram the language lacks counts ``top``. The nearest language is predicted.

An n-gram is one integer (21 bits a character). Learning counts them per task and language in
bounded buffers, so a language with a third of all rows is a few thousand counts a task; the two
level top-k ranks them. Profiles are ``top`` rows per language: that many are fetched and sent to
the tasks, after their number of languages is checked against ``max_languages``.

Defined results: null texts and texts without a letter are ``und`` with score 0, and teach
nothing; if nothing was learned every text is ``und``; equal counts rank by the n-gram's
characters, equal distances go to the smaller language value; null ids count as the empty text
in the fold and are learned from; repeated rows count and are predicted each; any text length is
whole (counted in blocks of ``CHUNK`` characters); an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import frozen, plain_columns
from tuneprep.operators.ranking import top_k_per_key

TOP = 400
MAX_LANGUAGES = 1024
SEPARATOR = ord("_")
BITS = 21               # of a code point
CHUNK = 1 << 20         # characters whose n-grams are held at once
BUFFER = 1 << 21        # n-gram counts a task holds before it merges them
DISTINCT = 1 << 19      # merged counts a task holds before it hands them on
UNKNOWN = "und"

Counts = tuple[np.ndarray, np.ndarray]


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased words, separated and enclosed by ``SEPARATOR``."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return codes[:0]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first character after a word
    words = np.where(letter, codes, SEPARATOR)[kept]
    return np.concatenate([[SEPARATOR], words, [SEPARATOR][:int(letter[-1])]])


def merged(parts: list[Counts]) -> Counts:
    if len(parts) == 1:
        return parts[0]
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, where, np.concatenate([n for _, n in parts]))
    return grams, counts


def gram_counts(codes: np.ndarray) -> Counts:
    """Distinct n-grams, ascending, and how often each occurs."""
    parts = []
    for at in range(0, len(codes), CHUNK):
        c = codes[at:at + CHUNK + 2].astype(np.int64)
        word = c != SEPARATOR
        two = c[:-1] << BITS | c[1:]
        three = two[:-1] << BITS | c[2:]
        parts.append(np.unique(np.concatenate([
            c[:CHUNK][word[:CHUNK]], two[:CHUNK], three[:CHUNK][word[1:-1][:CHUNK]],
        ]), return_counts=True))
    return merged(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ranked(counts: Counts, top: int) -> np.ndarray:
    """The most frequent n-grams, best first."""
    grams, n = counts
    return grams[np.lexsort((grams, -n))[:top]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each task, merged in bounded buffers."""
    held: dict[str, list[Counts]] = defaultdict(list)
    size = 0

    def merge() -> int:
        for lang, parts in held.items():
            held[lang] = [merged(parts)]
        return sum(len(parts[0][0]) for parts in held.values())

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            counts = gram_counts(letter_codes(text.as_py()))
            held[lang.as_py()].append(counts)
            size += len(counts[0])
            if size > BUFFER:
                size = merge()
                if size > DISTINCT:
                    yield from rows()
                    size = 0
    yield from rows()


def profiles(texts: DataFrame, top: int = TOP, max_languages: int = MAX_LANGUAGES
             ) -> dict[str, np.ndarray]:
    """Language to its ``top`` n-grams, best first, from rows of (lang, text)."""
    learned = texts.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = learned.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    best = frozen(top_k_per_key(counts, ["lang"], [F.col("n").desc(), F.col("gram")], top,
                                rank="place"), "profiles")
    languages = best.select("lang").distinct().count()
    if languages > max_languages:
        raise ValueError(f"{languages} languages to learn, more than max_languages={max_languages}")
    found: dict[str, list] = defaultdict(list)
    for row in best.select("lang", "place", "gram").collect():
        found[row["lang"]].append((row["place"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(rows)], np.int64)
            for lang, rows in sorted(found.items())}


class Nearest:
    """Distances of a document's n-grams to all profiles at once."""

    def __init__(self, learned: dict[str, np.ndarray], top: int = TOP):
        self.languages = list(learned)
        self.top = top
        self.grams = np.unique(np.concatenate([*learned.values(), np.zeros(0, np.int64)]))
        self.places = np.full((len(self.grams) + 1, len(learned)), -1, np.int64)
        for column, grams in enumerate(learned.values()):
            self.places[np.searchsorted(self.grams, grams), column] = np.arange(len(grams))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, grams)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[known]
        places = self.places[np.where(known, at, len(self.grams))]
        apart = np.abs(places - np.arange(len(grams))[:, None])
        return np.where(places >= 0, apart, self.top).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language, and by which share of its distance the next one is farther off."""
        codes = letter_codes(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        away = self.distances(ranked(gram_counts(codes), self.top))
        best, *rest = np.argsort(away, kind="stable")
        if not rest:
            return self.languages[best], 1.0
        second = int(away[rest[0]])
        return self.languages[best], (second - int(away[best])) / second if second else 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: a third, by a checksum of the id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, learned: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to (doc_id, text) rows; the text goes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(learned, top)
        for batch in batches:
            found = [nearest.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([lang for lang, _ in found], pa.string()),
                 pa.array([score for _, score in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def language_report(docs: DataFrame, top: int = TOP, max_languages: int = MAX_LANGUAGES,
                    doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Profiles come from the rows that are not held out; every row is predicted from its text alone.
    """
    rows = plain_columns(docs, {"doc_id": doc_id, "text": text, "lang": lang})
    learned = profiles(rows.where(~held_out(F.col("doc_id"))), top, max_languages)
    return identify(rows, learned, top).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
