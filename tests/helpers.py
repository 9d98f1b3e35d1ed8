"""Small literal inputs."""

from tuneprep.schema import MESSAGES
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("ord", T.LongType()), T.StructField("messages", MESSAGES)])


def chat(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


def records(spark, chats):
    return spark.createDataFrame([(i, c) for i, c in enumerate(chats)], RECORD)


def turns(spark, rows):
    return spark.createDataFrame(rows, "ord bigint, turn bigint, role string, content string")


def stats(df):
    return {r["outcome"]: r["n"] for r in df.collect()}


THREE = [
    chat(("user", "你好，请介绍一下自己"), ("assistant", "我是一个有用的助手")),
    chat(("user", "什么是列表推导式？"), ("assistant", "一种简洁的写法，用于生成列表")),
    chat(("user", "给一个例子"), ("assistant", "```python\nprint([i for i in range(3)])\n```\n完成")),
]
