"""Substring de-duplication against a dictionary of all windows."""

import tracemalloc

import pyarrow as pa
import samples

from tuneprep.llm import substrings
from tuneprep.llm.substrings import without_repeats

LAST = 1 << 63


def expected(rows):
    words = [(LAST if k is None else k, k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for order, _, w in words:
        for i in range(len(w) - 12):
            key = tuple(w[i:i + 13])
            first[key] = min(first.get(key, order), order)
    for order, k, w in words:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < order
                for j in range(i, i + 13)}
        yield k, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def check(spark, rows, **options):
    got = without_repeats(samples.table(spark, rows).repartition(5), **options).collect()
    assert samples.by_row(got, ["doc_id", "n_words", "n_removed", "kept"]) == sorted(
        expected(rows), key=repr)


def mixed():
    rows = [(k, t) for k, t, _ in samples.documents()] + [(k and k + 10**6, t) for k, t in samples.ROWS]
    passage = "this passage of exactly thirteen words stands in several texts without any change"
    assert len(passage.split()) == 13
    rows += [(5000 + i, f"start{i} {passage} end{i}") for i in range(9)]
    return rows + [(5003, "same id, other text, " + passage)]


def test_documents(spark):
    check(spark, mixed())


def test_several_rounds_and_a_full_sketch(spark):
    check(spark, mixed(), max_bits=16)


def test_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 50)
    check(spark, mixed()[:80])


def test_empty(spark):
    assert without_repeats(samples.table(spark, [])).count() == 0


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 50)
    monkeypatch.setattr(substrings, "PIECE_WORDS", 400)
    monkeypatch.setattr(substrings, "OUT_BYTES", 300)
    check(spark, mixed()[:80] + mixed()[-12:])


def test_memory_does_not_follow_the_batch():
    """A batch of two million words: words are held for a chunk, hashes for a piece."""
    texts = pa.array([" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(1000)])
    tracemalloc.start()
    hashed = (substrings.hashed_windows(words, 13)[:2] for _, words in substrings.chunks(texts))
    sizes = [len(h1) for h1, _ in substrings.pieces(hashed, 1 << 18)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 1000 * 1988 and len(sizes) > 4
    assert peak < 60e6      # 20 MB; 136 MB with chunks of 2**20 words
