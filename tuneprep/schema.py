"""Canonical record types shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)
TURN = T.StructType(
    [
        T.StructField("from", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)
ALPACA = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)
# One harvested reply item: any of the record shapes the importer understands.
ANY_RECORD = T.StructType(
    [
        T.StructField("messages", MESSAGES),
        T.StructField("conversations", T.ArrayType(TURN)),
        *ALPACA.fields,
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("reply", T.StringType()),
    ]
)
LOG_METRIC = T.StructType(
    [
        T.StructField("step", T.DoubleType()),
        T.StructField("epoch", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("grad_norm", T.DoubleType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
    ]
)
TRAINER_ROW = T.StructType(
    [
        T.StructField("loss", T.DoubleType()),
        T.StructField("elapsed_time", T.StringType()),
        T.StructField("current_steps", T.LongType()),
        T.StructField("epoch", T.DoubleType()),
    ]
)

# Every code point that Python's ``str.strip`` removes (29 of them).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
