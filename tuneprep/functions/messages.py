"""Expressions over one chat record: conversion, measures, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneprep.functions.text import strip
from tuneprep.rules.terms import ASSISTANT_ROLES, CHAT_MARKUP, USER_ROLES
from tuneprep.schema import MESSAGES


def message(role, content: Column) -> Column:
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(role.alias("role"), content.alias("content"))


def _present(pairs: list[tuple[str, Column]]) -> Column:
    """Messages for the non-empty texts, in order."""
    items = F.array(*[message(r, F.coalesce(c, F.lit(""))) for r, c in pairs])
    return F.filter(items, lambda m: m["content"] != "").cast(MESSAGES)


def alpaca_messages(instruction: Column, input_: Column, output: Column) -> Column:
    """Instruction (plus a blank line and the input, when there is one) and output."""
    instruction = F.coalesce(instruction, F.lit(""))
    extra = F.coalesce(input_, F.lit(""))
    user = F.when(extra != "", F.concat(instruction, F.lit("\n\n"), extra)).otherwise(instruction)
    return _present([("user", user), ("assistant", output)])


def qa_messages(questions: list[Column], answers: list[Column]) -> Column:
    """First present question field and first present answer field."""
    return _present([("user", F.coalesce(*questions)), ("assistant", F.coalesce(*answers))])


def speaker(turn: Column, fields: list[str]) -> Column:
    names = [turn[f] for f in ("from", "role") if f in fields]
    return F.coalesce(*names, F.lit(""))


def spoken(turn: Column, fields: list[str]) -> Column:
    names = [turn[f] for f in ("value", "content") if f in fields]
    return F.coalesce(*names, F.lit(""))


def conversation_messages(turns: Column, fields: list[str], keep_system: bool = False) -> Column:
    """Map speakers to user/assistant; anything unknown (system too) becomes user."""

    def convert(turn: Column) -> Column:
        who = speaker(turn, fields)
        role = F.when(who.isin(ASSISTANT_ROLES), "assistant")
        if keep_system:
            role = role.when(who == "system", "system")
        return message(role.otherwise("user"), spoken(turn, fields))

    return F.transform(turns, convert).cast(MESSAGES)


def trim_messages(messages: Column) -> Column:
    return F.transform(
        messages, lambda m: message(m["role"], F.coalesce(strip(m["content"]), F.lit("")))
    ).cast(MESSAGES)


def has_text(messages: Column, stripped: bool = False) -> Column:
    """Any message with more than whitespace; ``stripped`` says contents are trimmed already."""
    return F.exists(messages, lambda m: F.coalesce(
        m["content"] if stripped else strip(m["content"]), F.lit("")) != "")


def text_length(messages: Column, role: str | None = None) -> Column:
    """Characters over all messages, or over one role's messages."""

    def add(acc: Column, m: Column) -> Column:
        size = F.length(F.coalesce(m["content"], F.lit(""))).cast("long")
        if role is not None:
            size = F.when(m["role"] == role, size).otherwise(F.lit(0).cast("long"))
        return acc + size

    return F.aggregate(messages, F.lit(0).cast("long"), add)


def role_count(messages: Column, role: str) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] == role)).cast("long")


def fingerprint(messages: Column) -> Column:
    """Equality key of the whole message list: 32 bytes of SHA-256."""
    ordered = F.transform(messages, lambda m: F.struct(m["content"], m["role"]))
    return F.unhex(F.sha2(F.to_json(ordered), 256))


def _last(items: Column, keep, text) -> Column:
    kept = F.filter(items, keep)
    return F.when(F.size(kept) > 0, text(F.element_at(kept, -1)))


def last_user_and_assistant(messages: Column) -> tuple[Column, Column]:
    """Last user and last assistant text of a chat; null when there is none."""
    return (
        _last(messages, lambda m: m["role"] == "user", lambda m: m["content"]),
        _last(messages, lambda m: m["role"] == "assistant", lambda m: m["content"]),
    )


def last_speakers(turns: Column, fields: list[str]) -> tuple[Column, Column]:
    """The same for conversation records; other roles are ignored."""
    return (
        _last(turns, lambda t: speaker(t, fields).isin(USER_ROLES), lambda t: spoken(t, fields)),
        _last(turns, lambda t: speaker(t, fields).isin(ASSISTANT_ROLES),
              lambda t: spoken(t, fields)),
    )


def render_chat(messages: Column, template: str) -> Column:
    """Training text of a chat in one template's markup; non-assistant turns read as user."""
    markup = CHAT_MARKUP[template]
    (u_open, u_close), (a_open, a_close) = markup["user"], markup["assistant"]
    lines = F.transform(
        messages,
        lambda m: F.when(
            m["role"] == "assistant", F.concat(F.lit(a_open), m["content"], F.lit(a_close))
        ).otherwise(F.concat(F.lit(u_open), m["content"], F.lit(u_close))),
    )
    return F.array_join(lines, markup["joiner"])
