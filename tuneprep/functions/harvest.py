"""Find JSON record lists inside model replies (the one text-parsing Python step)."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's functions with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- Fixed values: keys that mark a record, and the Markdown fence around a reply ---
RECORD_KEYS = ("instruction", "messages", "conversations")
FENCE_OPEN = re.compile(r"^```(?:json)?\s*\n")
FENCE_CLOSE = re.compile(r"\n```\s*$")
BRACKET = re.compile(r"[\[\]]")


def _spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every bracket pair by start; brackets in strings count as brackets."""
    waiting: list[int] = []
    closed: dict[int, int] = {}
    for hit in BRACKET.finditer(text):
        if hit.group() == "[":
            waiting.append(hit.start())
        elif waiting:
            closed[waiting.pop()] = hit.end()
    for start in sorted(closed):
        yield start, closed[start]


def _parse_list(text: str) -> list | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, list) else None


def find_records(text: str | None, single: bool = False) -> list:
    """Items of the first list that holds only records; otherwise of the unfenced reply.

    With ``single`` an unfenced reply that is one object counts as a list of one.
    """
    if not text:
        return []
    for start, end in _spans(text):
        items = _parse_list(text[start:end])
        if items is not None and all(
            isinstance(i, dict) and any(k in i for k in RECORD_KEYS) for i in items
        ):
            if items:
                return items
            break
    bare = FENCE_CLOSE.sub("", FENCE_OPEN.sub("", text.strip()))
    if single and bare.startswith("{"):
        return _parse_list(f"[{bare}]") or []
    return _parse_list(bare) or []


def reply_items(text: Column, single: bool = False) -> Column:
    """JSON text of each harvested object."""

    def objects(reply: str | None) -> list[str]:
        found = find_records(reply, single)
        return [json.dumps(i, ensure_ascii=False) for i in found if isinstance(i, dict)]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(objects)

    return items(text)
