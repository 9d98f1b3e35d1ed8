"""Chat formatting: a state machine over roles, and a declarative template with loss flags.

Method: a finite-state machine over the roles of a conversation validates the order of its turns;
a template gives each role its opening and closing mark and whether its text counts for the loss.
A conversation becomes text segments with loss flags; their concatenation is the formatted text.

Texts may hold control strings. A control string is one first character and a rest; in a text,
every such first character that is followed by any number of backslashes and that rest gets one
more backslash, so no control string is left, and taking one away restores the text exactly.
``read_back`` parses turns and loss texts from the output alone.

Defined results: conversations whose order is not accepted are formatted too, with ``valid``
false; null roles and texts count as empty; rows with the same turn are ordered by role, then
text, repeated rows stay; null conversation ids form one conversation; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.common import plain_columns, with_default


@dataclass(frozen=True)
class Role:
    """Marks around a role's text, and whether the text counts for the loss."""

    name: str
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles with marks of their own; other roles are spelled out between ``other`` marks.

    ``controls`` are the control strings of all marks. ``moves`` are the machine's transitions
    (state, role, next state), from the state "start"; ``accept`` are its final states.
    """

    roles: tuple[Role, ...] = (
        Role("system", "<<SYS>>", "<</SYS>>"),
        Role("user", "[INST] ", " [/INST]"),
        Role("assistant", "<s>", "</s>", True),
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]",
                                 "[ROLE]", "[/ROLE]", "[END]")
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "briefed"), ("start", "user", "asked"), ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    accept: tuple[str, ...] = ("asked", "answered")


def _rests(template: Template) -> dict[str, str]:
    """First character -> alternatives of what follows it in a control string."""
    firsts = dict.fromkeys(c[0] for c in template.controls)
    return {a: "|".join(re.escape(c[1:]) for c in template.controls if c[0] == a) for a in firsts}


def escaped(text: Column, template: Template) -> Column:
    for first, rests in _rests(template).items():
        text = F.regexp_replace(text, rf"({re.escape(first)}\\*)(?={rests})", r"$1\\")
    return text


def unescaped(text: Column, template: Template) -> Column:
    for first, rests in _rests(template).items():
        text = F.regexp_replace(text, rf"({re.escape(first)}\\*)\\(?={rests})", "$1")
    return text


def final_state(roles: Column, template: Template) -> Column:
    """State of the machine after all roles; "rejected" once a move is missing."""
    moves = F.create_map(*[F.lit(x) for state, role, then in template.moves
                           for x in (f"{state} {role}", then)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(
        F.try_element_at(moves, F.concat_ws(" ", state, role)), F.lit("rejected")))


def turn_segments(turn: Column, template: Template) -> Column:
    """Opening mark, text and closing mark of one turn, as segments with loss flags."""
    def segment(text: Column, loss: bool = False) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    text = escaped(turn["text"], template)
    begin, end, close = template.other
    out = F.array(segment(F.concat(F.lit(begin), escaped(turn["role"], template), F.lit(end))),
                  segment(text), segment(F.lit(close)))
    for role in reversed(template.roles):
        out = F.when(turn["role"] == role.name, F.array(
            segment(F.lit(role.open)), segment(text, role.loss), segment(F.lit(role.close)))
        ).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, valid, segments, formatted) per conversation."""
    base = plain_columns(turns, {"conv_id": conv_id, "turn": turn, "role": role, "text": text})
    chats = base.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", with_default(F.col("role")).alias("role"),
        with_default(F.col("text")).alias("text")))).alias("turns"))
    state = final_state(F.transform("turns", lambda t: t["role"]), template)
    return chats.select(
        "conv_id", state.isin(*template.accept).alias("valid"),
        F.flatten(F.transform("turns", lambda t: turn_segments(t, template))).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed_turns(formatted: Column, template: Template) -> Column:
    """Turns (role, text) read from a formatted text."""
    begin, end, close = template.other
    shapes = [f"{re.escape(r.open)}.*?{re.escape(r.close)}" for r in template.roles]
    shapes.append(f"{re.escape(begin)}.*?{re.escape(end)}.*?{re.escape(close)}")

    def turn(part: Column) -> Column:
        def inner(opening: Column, closing: int) -> Column:
            return F.substring(part, opening + 1, F.length(part) - opening - closing)

        cut = F.instr(part, end) + (len(end) - 1)
        out = F.struct(
            unescaped(F.substring(part, F.lit(len(begin) + 1),
                                  F.instr(part, end) - (len(begin) + 1)), template).alias("role"),
            unescaped(inner(cut, len(close)), template).alias("text"))
        for r in reversed(template.roles):
            out = F.when(F.startswith(part, F.lit(r.open)), F.struct(
                F.lit(r.name).alias("role"),
                unescaped(inner(F.lit(len(r.open)), len(r.close)), template).alias("text"))
            ).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s){'|'.join(shapes)}"), F.lit(0)),
                       turn)


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, valid, formatted, turns, loss_text), from formatted text and segments alone."""
    loss = F.transform(F.filter("segments", lambda s: s["loss"]),
                       lambda s: unescaped(s["text"], template))
    return chats.select("conv_id", "valid", "formatted",
                        parsed_turns(F.col("formatted"), template).alias("turns"),
                        F.array_join(loss, "").alias("loss_text"))


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Numbers and digests of what ``read_back`` finds."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(chats, template).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
