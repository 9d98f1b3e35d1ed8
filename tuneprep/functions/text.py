"""String helpers."""

from __future__ import annotations

import fnmatch
import json
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneprep.schema import WHITESPACE


def strip(col: Column) -> Column:
    """Remove the same whitespace code points as Python's ``str.strip``."""
    return F.btrim(col, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let`` as an outer explode of one element, for use in a select.

    The optimizer does not push filters on the result below the explode, so an expensive
    expression that is also filtered on is evaluated one time per row instead of twice.
    """
    return F.explode_outer(F.transform(F.array(value), body))


def contains_any(col: Column, terms: list[str]) -> Column:
    """True when any term is a substring; bind computed text with ``let`` first."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(col, F.lit(term))
    return hit


def first_contained(text: Column, entries: list[tuple[str, object]],
                    kind: str = "string") -> Column:
    """Value of the first pattern (in list order) contained in the text, or null.

    The list is one JSON constant, folded by the optimizer, so the plan stays small.
    """
    rows = json.dumps([{"p": p, "v": v} for p, v in entries], ensure_ascii=False)
    table = F.from_json(F.lit(rows), f"array<struct<p:string,v:{kind}>>")
    return let(text, lambda t: F.get(
        F.filter(table, lambda e: F.contains(t, e["p"])), 0)["v"])


def longest_contained(text: Column, entries: list[tuple[str, object]],
                      kind: str = "string") -> Column:
    """Value of the longest contained pattern; equal lengths go to the earlier entry."""
    return first_contained(text, sorted(entries, key=lambda e: -len(e[0])), kind)


def cjk_chars(col: Column) -> Column:
    """Number of characters in U+4E00..U+9FFF."""
    others = F.regexp_replace(col, "[\\x{4E00}-\\x{9FFF}]+", "")
    return (F.length(col) - F.length(others)).cast("long")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def matches_glob(name: Column, patterns: list[str]) -> Column:
    """Shell-style match of a whole file name; bind computed names with ``let`` first."""
    hit = F.lit(False)
    for pattern in patterns:
        tail = pattern[1:]
        if not set(pattern) & set("*?["):
            test = name == pattern
        elif pattern[0] == "*" and not set(tail) & set("*?["):
            test = F.endswith(name, F.lit(tail))
        else:
            test = name.rlike("^" + fnmatch.translate(pattern).replace("\\z", "\\Z"))
        hit = hit | test
    return hit


def round_even(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals with ties to even, as Python's ``round`` does."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def step_table(value: Column, steps: list[tuple], otherwise, *, inclusive: bool = False) -> Column:
    """CASE over ascending upper bounds: ``value < bound`` (or ``<=``) picks the entry."""
    out = None
    for bound, entry in steps:
        test = value <= F.lit(bound) if inclusive else value < F.lit(bound)
        out = F.when(test, F.lit(entry)) if out is None else out.when(test, F.lit(entry))
    return out.otherwise(F.lit(otherwise))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Concatenate a ``{name}`` template with columns; values are never re-scanned."""
    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(values[name].cast("string"))
    return F.concat(*pieces)
