import pytest
from helpers import THREE, chat, records, turns
from pyspark.sql import functions as F

from tuneprep.functions.messages import render_chat
from tuneprep.operators import formats as FM
from tuneprep.operators import sample as SA


def texts(df):
    return [[(m["role"], m["content"]) for m in r["messages"]] for r in df.orderBy("ord").collect()]


def test_alpaca(spark):
    rows = spark.createDataFrame(
        [(0, "do", "", "done"), (1, "do", "this", "done"), (2, "", "", ""), (3, "do", None, "")],
        "ord bigint, instruction string, input string, output string")
    assert FM.detect_schema_format(rows.schema) == "alpaca"
    assert texts(FM.to_messages(rows)) == [
        [("user", "do"), ("assistant", "done")],
        [("user", "do\n\nthis"), ("assistant", "done")],
        [("user", "do")],
    ]


def test_conversation_roles(spark):
    rows = spark.createDataFrame(
        [(0, [("human", "a"), ("gpt", "b"), ("bot", "c"), ("system", "d"), ("from", "")])],
        "ord bigint, conversations array<struct<from:string,value:string>>")
    assert FM.detect_schema_format(rows.schema) == "conversation"
    assert texts(FM.to_messages(rows)) == [[
        ("user", "a"), ("assistant", "b"), ("assistant", "c"), ("user", "d"), ("user", "")]]
    assert texts(FM.to_messages(rows, keep_system=True))[0][3] == ("system", "d")
    row = FM.to_alpaca(rows).first()
    assert (row.instruction, row.input, row.output) == ("a", "", "c")


def test_conversation_with_role_and_content(spark):
    rows = spark.createDataFrame(
        [(0, [("user", "a"), ("assistant", "b")])],
        "ord bigint, conversations array<struct<role:string,content:string>>")
    assert texts(FM.to_messages(rows)) == [[("user", "a"), ("assistant", "b")]]


@pytest.mark.parametrize("compat,want", [(False, 1), (True, 0)])
def test_question_answer_rows(spark, compat, want):
    rows = spark.createDataFrame([(0, "q", "a")], "ord bigint, question string, answer string")
    assert FM.detect_schema_format(rows.schema) == "alpaca"
    assert FM.to_messages(rows, compat=compat).count() == want


def test_raw_rows(spark):
    rows = spark.createDataFrame([(0, "q", "a"), (1, None, None)],
                                 "ord bigint, query string, reply string")
    assert FM.detect_schema_format(rows.schema) == "raw"
    assert texts(FM.to_messages(rows)) == [[("user", "q"), ("assistant", "a")]]


def test_messages_to_alpaca_takes_the_last(spark):
    data = records(spark, [
        chat(("user", "1"), ("assistant", "2"), ("user", "3"), ("assistant", "4")),
        chat(("user", "only")), chat(("user", "x"), ("assistant", "y"), ("user", "")),
    ])
    got = FM.to_alpaca(data).collect()
    assert [(r.ord, r.instruction, r.output) for r in got] == [(0, "3", "4")]


def test_round_trip(spark):
    single = records(spark, THREE)
    assert texts(FM.to_messages(FM.to_alpaca(single))) == texts(single)


def test_long_chat_is_one_row(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(9000)]
    data = turns(spark, rows).repartition(6)
    chats = FM.assemble_chats(data)
    got = chats.collect()
    assert [[m["content"] for m in r["messages"]] for r in got] == [[f"t{i}" for i in range(9000)]]
    pair = [(r.ord, r.instruction, r.output) for r in FM.to_alpaca(chats).collect()]
    assert pair == [(7, "t8998", "t8999")]
    assert pair == [(r.ord, r.instruction, r.output) for r in FM.turns_to_alpaca(data).collect()]


def test_turn_rows_need_no_sort_of_texts(spark, capsys):
    FM.turns_to_alpaca(turns(spark, [(1, 0, "user", "a")])).explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_rendering(spark):
    data = records(spark, [chat(("user", "q"), ("assistant", "a"))])
    got = {n: data.select(render_chat(F.col("messages"), n).alias("t")).first().t
           for n in ("chatml", "mistral", "deepseek")}
    assert got == {
        "chatml": "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>",
        "mistral": "[INST] q [/INST] a",
        "deepseek": "User: q\n\nAssistant: a",
    }


@pytest.mark.parametrize("n,ratio,train", [(30, 0.8, 24), (10, 0.8, 8), (7, 1.0, 7), (3, 0.1, 0)])
@pytest.mark.parametrize("shuffle", [True, False])
def test_split_is_exact(spark, n, ratio, train, shuffle):
    rows = SA.split_train_val(spark.range(n).withColumnRenamed("id", "ord"), ratio, shuffle)
    got = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert got.get("train", 0) == train and sum(got.values()) == n


def test_split_depends_on_the_seed_only(spark):
    rows = spark.range(50).withColumnRenamed("id", "ord")

    def train(df, seed):
        return {r.ord for r in SA.split_train_val(df, 0.5, seed=seed).filter("split='train'").collect()}

    assert train(rows, 1) == train(rows.repartition(5), 1) != train(rows, 2)


def test_preview(spark):
    rows = spark.range(30).withColumnRenamed("id", "ord")
    assert [r.ord for r in SA.preview_even(rows, 2).orderBy("pos").collect()] == [0, 15]
    assert SA.preview_even(spark.range(5).withColumnRenamed("id", "ord"), 3).count() == 3
    assert SA.preview_even(spark.range(2).withColumnRenamed("id", "ord"), 3).count() == 2
    sparse = rows.selectExpr("ord * ord * 100000 AS ord")
    assert [r.pos for r in SA.preview_even(sparse, 4).orderBy("pos").collect()] == [0, 7, 15, 22]
