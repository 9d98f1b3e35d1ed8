"""Format detection and conversion between record shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions import messages as M
from tuneprep.functions.text import once
from tuneprep.schema import MESSAGES

ALPACA_PAIRS = [
    ("instruction", "output"), ("input", "output"), ("prompt", "response"),
    ("question", "answer"),
]
QUESTION_FIELDS = ["question", "prompt", "query"]
ANSWER_FIELDS = ["answer", "response", "reply"]


def detect_schema_format(schema: T.StructType) -> str:
    """Format implied by the columns a table has."""
    kinds = {f.name: f.dataType for f in schema.fields}
    if not kinds:
        return "unknown"
    if isinstance(kinds.get("messages"), T.ArrayType):
        return "sharegpt"
    if isinstance(kinds.get("conversations"), T.ArrayType):
        return "conversation"
    if any(q in kinds and a in kinds for q, a in ALPACA_PAIRS):
        return "alpaca"
    return "raw"


def row_format(df: DataFrame) -> Column:
    """Format of each row of a mixed table: the first shape whose columns are filled."""
    names = df.columns

    def filled(column: str) -> Column:
        return F.col(column).isNotNull() if column in names else F.lit(False)

    alpaca = F.lit(False)
    for question, answer in ALPACA_PAIRS:
        alpaca = alpaca | (filled(question) & filled(answer))
    return (
        F.when(filled("messages"), "sharegpt")
        .when(filled("conversations"), "conversation")
        .when(alpaca, "alpaca")
        .otherwise("raw")
    )


def _turn_fields(df: DataFrame) -> list[str]:
    return df.schema["conversations"].dataType.elementType.fieldNames()


def _pick(df: DataFrame, fields: list[str]) -> list[Column]:
    return [F.col(f).cast("string") for f in fields if f in df.columns] or [F.lit("")]


def to_messages(df: DataFrame, fmt: str | None = None, compat: bool = False,
                keep_system: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Any supported record table to (``keep`` columns, messages).

    Rows are converted by their own shape unless ``fmt`` fixes one for the table. Question and
    prompt fields feed rows whose instruction/output are missing; with ``compat`` such rows are
    dropped, as a strict instruction reader would. Rows without any message are dropped.
    """
    keep = [c for c in (keep if keep is not None else ["ord"]) if c in df.columns]
    names = df.columns
    label = F.lit(fmt) if fmt else row_format(df)
    empty = F.array().cast(MESSAGES)

    def text(column: str) -> Column:
        return F.col(column).cast("string") if column in names else F.lit(None).cast("string")

    qa = M.qa_messages(_pick(df, QUESTION_FIELDS), _pick(df, ANSWER_FIELDS))
    alpaca = M.alpaca_messages(text("instruction"), text("input"), text("output"))
    if not compat:
        alpaca = F.when(F.size(alpaca) > 0, alpaca).otherwise(qa)
    messages = F.when(label == "alpaca", alpaca).when(label == "raw", qa)
    if "messages" in names:
        messages = messages.when(label == "sharegpt", F.col("messages").cast(MESSAGES))
    if "conversations" in names:
        messages = messages.when(
            label == "conversation",
            M.conversation_messages(F.col("conversations"), _turn_fields(df), keep_system),
        )
    if fmt == "sharegpt":
        return df.select(*keep, F.coalesce(messages, empty).alias("messages"))
    converted = once(F.coalesce(messages, empty), lambda m: m).alias("messages")
    return df.select(*keep, converted).filter(F.size("messages") > 0)


def to_alpaca(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Chats or conversations to instruction rows: last user and last assistant text."""
    keep = [c for c in (keep if keep is not None else ["ord"]) if c in df.columns]
    fmt = detect_schema_format(df.schema)
    if fmt == "alpaca":
        return df
    if fmt == "sharegpt":
        user, assistant = M.last_user_and_assistant(F.col("messages"))
    elif fmt == "conversation":
        user, assistant = M.last_speakers(F.col("conversations"), _turn_fields(df))
    else:
        return df.select(*keep, F.lit("").alias("instruction"), F.lit("").alias("input"),
                         F.lit("").alias("output")).filter(F.lit(False))
    pair = F.struct(user.alias("instruction"), F.lit("").alias("input"), assistant.alias("output"))
    return df.select(*keep, once(pair, lambda p: p).alias("_p")).select(*keep, "_p.*").filter(
        (F.col("instruction") != "") & (F.col("output") != "")
    )


def assemble_chats(turns: DataFrame, fields: tuple[str, str] = ("role", "content"),
                   out: str = "messages") -> DataFrame:
    """(ord, turn, role, content) rows to one array per chat, ordered by turn.

    Each task collects the turns it has of a chat; these partial arrays meet in the chat's row,
    however many turns it has. Use the operators on turn rows where an array is not wanted.
    """
    who, what = fields
    item = F.struct("turn", F.col("role").alias(who), F.col("content").alias(what))
    ordered = F.sort_array(F.collect_list(item))
    return turns.groupBy("ord").agg(
        F.transform(ordered, lambda t: F.struct(t[who].alias(who), t[what].alias(what)))
        .alias(out)
    )


def turns_to_alpaca(turns: DataFrame) -> DataFrame:
    """Instruction rows straight from turn rows: last user and last assistant text per chat.

    The last turn numbers are found first, by a hash aggregate on numbers alone; only the texts of
    those turns are then brought together, so a chat of any length needs no array and no sort.
    """
    roles = F.col("role").isin("user", "assistant")
    last = (turns.filter(roles).groupBy("ord", "role").agg(F.max("turn").alias("turn")))
    texts = turns.join(last, ["ord", "role", "turn"], "left_semi").select("ord", "role", "content")
    pairs = texts.filter(F.col("role") == "user").select("ord", F.col("content").alias("instruction"))
    answers = texts.filter(F.col("role") == "assistant").select(
        "ord", F.col("content").alias("output"))
    return pairs.join(answers, "ord").select(
        "ord", "instruction", F.lit("").alias("input"), "output").filter(
        (F.col("instruction") != "") & (F.col("output") != "")
    )
