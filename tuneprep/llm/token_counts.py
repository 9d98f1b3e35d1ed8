"""Token counts that follow edits, from segment trees over pre-tokens.

Method: a document's pre-tokens are gathered into leaves of about ``leaf_chars`` characters; a
segment tree holds the sums of characters and tokens above them. An edit finds its leaves by
descending the character sums, re-encodes only the text of these leaves, and adds the changes to
the sums above. Leaves begin where a run of white space begins, or where a sentence mark follows
a letter (texts of some languages have no spaces): there the tokenizer starts a new pre-token
whatever stands before or after it. So leaves are encoded apart; an edit that touches the first
character of its leaves takes the leaf before with it, and one after which the next leaf no longer
begins at such a place takes that leaf, as boundary context.

Trees are kept as one row per document (``build_trees``); ``apply_edits`` reads texts, trees and
an edit table and returns the new texts with their trees, ``edited_counts`` the counts before and
after; ``count_edited`` does both steps for edits that come with the rows. Positions are code
points of the text as the edits before left it. Only the texts' join with their trees and edits
moves texts, once.

Defined results: null and empty texts have no tokens and one empty leaf; edits beyond the end of a
text act at its end, null parts of an edit count as 0 or empty; edits of a document are applied in
the order of ``seq``, ties in the order of their values; documents without edits keep their trees;
edits of unknown documents are ignored; rows of one id get the same edits each; a stretch without
white space and marks is one leaf, however long; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import map_with_ids, plain_columns, with_default
from tuneprep.llm.tokens import encoder

#: Places where a pre-token begins whatever is around: white space after another character, and
#: marks after letters (Latin, kana, Han, Hangul). The apostrophe is none, it may begin "'s".
SAFE = re.compile(
    "(?<=\\S)(?=\\s)|(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])"
    "(?=[.,;:!?\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
LEAF_CHARS = 256
EDIT = "struct<seq:bigint,start:bigint,length:bigint,text:string>"


def cut(text: str, leaf_chars: int) -> list[str]:
    """Leaves of at least ``leaf_chars`` characters each, but for the last."""
    out, start = [], 0
    while len(text) - start > leaf_chars:
        found = SAFE.search(text, start + leaf_chars)
        if not found:
            break
        out.append(text[start:found.start()])
        start = found.start()
    return [*out, text[start:]]


class TokenTree:
    """Sums of characters and tokens over the leaves, as a heap of two columns."""

    def __init__(self, chars, tokens):
        self.n = len(chars)
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width:self.width + self.n, 0] = chars
        self.sums[self.width:self.width + self.n, 1] = tokens
        level = self.width
        while level > 1:
            half = level // 2
            self.sums[half:level] = (self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2])
            level = half

    @property
    def chars(self) -> np.ndarray:
        return self.sums[self.width:self.width + self.n, 0]

    @property
    def tokens(self) -> np.ndarray:
        return self.sums[self.width:self.width + self.n, 1]

    @property
    def total(self) -> tuple[int, int]:
        return int(self.sums[1, 0]), int(self.sums[1, 1])

    def leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf, its first position) of the character; the last leaf beyond the end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            here = self.sums[node, 0]
            right = node + 1 - self.width if node >= self.width else None
            if position - before >= here and (right is None or right < self.n):
                before += here
                node += 1
        leaf = min(node - self.width, self.n - 1)
        return int(leaf), int(before)

    def start_of(self, leaf: int) -> int:
        """Characters before a leaf."""
        node, before = leaf + self.width, 0
        while node > 1:
            if node & 1:
                before += self.sums[node - 1, 0]
            node //= 2
        return int(before)

    def set_leaf(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


class EditedText:
    """A text with its tree; ``encoded`` counts the characters encoded so far."""

    def __init__(self, text: str, count, leaf_chars: int = LEAF_CHARS,
                 leaves: tuple[list[int], list[int]] | None = None):
        self.text, self.count, self.leaf_chars, self.encoded = text, count, leaf_chars, 0
        if leaves is None:
            parts = cut(text, leaf_chars)
            leaves = [len(p) for p in parts], [self._tokens(p) for p in parts]
        self.tree = TokenTree(*leaves)

    def _tokens(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text)

    def edit(self, start: int, length: int, text: str) -> None:
        tree, size = self.tree, len(self.text)
        start = min(max(start, 0), size)
        stop = min(start + max(length, 0), size)
        first, begin = tree.leaf_at(start)
        last, _ = tree.leaf_at(max(stop - 1, start))
        while start == begin and first > 0:
            first -= 1
            begin = tree.start_of(first)
        grown = len(text) - (stop - start)
        self.text = self.text[:start] + text + self.text[stop:]
        end = tree.start_of(last) + int(tree.chars[last]) + grown
        while last + 1 < tree.n and (end == begin or not SAFE.match(self.text, end)):
            last += 1
            end += int(tree.chars[last])
        region, places = self.text[begin:end], last - first + 1
        parts = cut(region, max(self.leaf_chars, -(-len(region) // places))) \
            if len(region) <= 2 * self.leaf_chars * places else cut(region, self.leaf_chars)
        counted = [(len(p), self._tokens(p)) for p in parts]
        if len(parts) <= places:
            for k in range(places):
                tree.set_leaf(first + k, *(counted[k] if k < len(parts) else (0, 0)))
        else:
            chars, tokens = (list(c) for c in zip(*counted))
            self.tree = TokenTree([*tree.chars[:first], *chars, *tree.chars[last + 1:]],
                                  [*tree.tokens[:first], *tokens, *tree.tokens[last + 1:]])


def counter(path: str | None):
    """Number of tokens of a text."""
    encode = encoder(path).encode
    return lambda text: len(encode(text)) // 4


def _edits(values) -> list[tuple[int, int, str]]:
    def order(e) -> tuple:
        return tuple((e[k] is not None, e[k]) if e[k] is not None else (False, 0 if k != "text" else "")
                     for k in ("seq", "start", "length", "text"))

    return [(int(e["start"] or 0), int(e["length"] or 0), e["text"] or "")
            for e in sorted(values if values is not None else [], key=order)]


def build_trees(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_tokens, leaf_chars, leaf_tokens) per document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            trees = [EditedText(t, count, leaf_chars).tree for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "text_hash": batch["text_hash"],
                "n_tokens": [t.total[1] for t in trees],
                "leaf_chars": [t.chars for t in trees], "leaf_tokens": [t.tokens for t in trees]})

    base = plain_columns(docs, {"doc_id": doc_id, "text": text}).select(
        "doc_id", with_default(F.col("text")).alias("text")).withColumn(
            "text_hash", F.xxhash64("text"))
    return map_with_ids(base, run, "doc_id", "doc_id {}, text_hash bigint, n_tokens bigint, "
                        "leaf_chars array<bigint>, leaf_tokens array<bigint>")


def _with_trees(docs: DataFrame, trees: DataFrame, edits: DataFrame, doc_id: str,
                text: str) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, edits): trees and edits meet before the texts."""
    base = plain_columns(docs, {"doc_id": doc_id, "text": text}).select(
        "doc_id", with_default(F.col("text")).alias("text")).withColumn(
            "text_hash", F.xxhash64("text"))
    kept = trees.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
                        "leaf_chars", "leaf_tokens").dropDuplicates(["_id", "_hash"])
    changes = edits.groupBy(F.col(f"`{doc_id}`").alias("_doc")).agg(F.collect_list(
        F.struct("seq", "start", "length", "text").cast(EDIT)).alias("edits"))
    small = kept.join(changes, kept["_id"] == changes["_doc"], "left")
    rows = base.join(small, (base["text_hash"] == small["_hash"])
                     & base["doc_id"].eqNullSafe(small["_id"]))
    return rows.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str | None = None,
                leaf_chars: int = LEAF_CHARS, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(doc_id, text, n_tokens, leaf_chars, leaf_tokens, encoded_chars) after the edits.

    ``edits``: doc_id, seq, start, length, text. The edits of one document are applied together.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            out = []
            for value, chars, tokens, changes in zip(batch["text"], batch["leaf_chars"],
                                                     batch["leaf_tokens"], batch["edits"]):
                state = EditedText(value, count, leaf_chars, (chars, tokens))
                for change in _edits(changes):
                    state.edit(*change)
                out.append((state.text, state.tree.total[1], state.tree.chars, state.tree.tokens,
                            state.encoded))
            names = ["text", "n_tokens", "leaf_chars", "leaf_tokens", "encoded_chars"]
            yield pd.DataFrame(out, columns=names).assign(doc_id=batch["doc_id"].to_numpy())

    return map_with_ids(
        _with_trees(docs, trees, edits, doc_id, text), run, "doc_id",
        "doc_id {}, text string, n_tokens bigint, leaf_chars array<bigint>, "
        "leaf_tokens array<bigint>, encoded_chars bigint")


COUNTS = ["n_chars", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "n_leaves",
          "encoded_chars"]
COUNT_SCHEMA = "doc_id {}, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _counts(state: EditedText, edits) -> tuple[int, ...]:
    """``COUNTS`` of one document; what its tree took to build is not counted as encoded."""
    before, todo, built = state.tree.total, _edits(edits), state.encoded
    for change in todo:
        state.edit(*change)
    after = state.tree.total
    return *before, len(todo), *after, state.tree.n, state.encoded - built


def edited_counts(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str | None = None,
                  leaf_chars: int = LEAF_CHARS, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` from kept trees and an edit table, as for ``apply_edits``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            out = [_counts(EditedText(value, count, leaf_chars, (chars, tokens)), changes)
                   for value, chars, tokens, changes in zip(
                       batch["text"], batch["leaf_chars"], batch["leaf_tokens"], batch["edits"])]
            yield pd.DataFrame(out, columns=COUNTS).assign(doc_id=batch["doc_id"].to_numpy())

    return map_with_ids(_with_trees(docs, trees, edits, doc_id, text), run, "doc_id", COUNT_SCHEMA)


def count_edited(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS,
                 doc_id: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Counts before and after the edits in an array column; no shuffle.

    doc_id, n_chars, n_tokens (before), n_edits, edited_chars, edited_tokens, n_leaves, and
    encoded_chars: the characters encoded again for the edits.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            out = [_counts(EditedText(value, count, leaf_chars), changes)
                   for value, changes in zip(batch["text"], batch["edits"])]
            yield pd.DataFrame(out, columns=COUNTS).assign(doc_id=batch["doc_id"].to_numpy())

    base = plain_columns(docs, {"doc_id": doc_id, "text": text, "edits": edits}).select(
        "doc_id", with_default(F.col("text")).alias("text"),
        F.col("edits").cast(f"array<{EDIT}>").alias("edits"))
    return map_with_ids(base, run, "doc_id", COUNT_SCHEMA)
