import pytest
from helpers import THREE, chat, records, stats, turns
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tuneprep.operators import clean as CL
from tuneprep.operators import ranking
from tuneprep.operators.profile import (
    language_hint, length_histogram, record_length_stats, record_measures, record_turns,
    role_length_stats, turn_measures,
)


def test_duplicates_and_empty(spark):
    got = stats(CL.clean_stats(records(spark, THREE + THREE + [[]])))
    assert got == {"total": 7, "kept": 3, "removed": 4, "empty": 1, "too_short": 0,
                   "too_long": 0, "duplicate": 3}


def test_short_row_counts_as_short(spark):
    long = THREE[0]
    got = stats(CL.clean_stats(records(spark, [long, long, long, [], chat(("user", "x"), ("assistant", "y"))])))
    assert (got["duplicate"], got["empty"], got["too_short"], got["kept"]) == (2, 1, 1, 1)


def test_five_copies(spark):
    got = stats(CL.clean_stats(records(spark, [THREE[1]] * 5 + [[]])))
    assert (got["duplicate"], got["empty"]) == (4, 1)


def test_length_is_checked_before_duplicates(spark):
    hi = chat(("user", "Hi"), ("assistant", "Hello"))
    got = stats(CL.clean_stats(records(spark, [hi, hi, [], chat(("user", "ok"))])))
    assert (got["too_short"], got["empty"], got["duplicate"]) == (3, 1, 0)


def test_first_copy_stays_and_text_is_trimmed(spark):
    padded = chat(("user", " 　你好，请介绍一下自己\t"), ("assistant", "我是一个有用的助手\n"))
    kept = CL.clean(records(spark, [padded, THREE[0], THREE[1]])).orderBy("ord").collect()
    assert [r["ord"] for r in kept] == [0, 2]
    assert kept[0]["messages"][0]["content"] == "你好，请介绍一下自己"


def test_options_off(spark):
    opts = CL.CleanOptions(remove_duplicates=False, remove_empty=False, min_length=0,
                           trim_whitespace=False)
    data = records(spark, [THREE[0], THREE[0], chat(("user", "  ")), []])
    got = stats(CL.clean_stats(data, opts))
    assert (got["kept"], got["empty"], got["duplicate"]) == (3, 1, 0)
    assert CL.clean(data, opts).count() == 3


def test_null_content_reads_as_empty(spark):
    got = stats(CL.clean_stats(records(spark, [chat(("user", None)), None])))
    assert got["empty"] == 2


def test_too_long(spark):
    data = records(spark, [chat(("user", "x" * 8192)), chat(("user", "x" * 8193))])
    got = stats(CL.clean_stats(data))
    assert (got["kept"], got["too_long"]) == (1, 1)


def test_turn_rows_give_the_same_as_nested(spark):
    chats = THREE + THREE[:1] + [chat(("user", "  "), ("assistant", "\n")), chat(("user", "hi")),
                                 chat(("user", "y" * 9000))]
    nested = records(spark, chats)
    flat = record_turns(nested)
    assert stats(CL.clean_turn_stats(flat)) == stats(CL.clean_stats(nested))
    got = {r["ord"]: r["messages"] for r in CL.clean_turns(flat).collect()}
    want = {r["ord"]: r["messages"] for r in CL.clean(nested).collect()}
    assert got == want


def test_order_of_turns_matters(spark):
    a = [(0, 0, "user", "one two three"), (0, 1, "user", "four five six")]
    b = [(1, 0, "user", "four five six"), (1, 1, "user", "one two three")]
    assert stats(CL.clean_turn_stats(turns(spark, a + b)))["duplicate"] == 0


@pytest.mark.parametrize("top_keys", [100_000, 2])
def test_cap_returns_exactly_n_rows(spark, monkeypatch, top_keys):
    monkeypatch.setattr(ranking, "TOP_KEYS", top_keys)
    keys = [None, 1, 1, 2, 2, 3, *range(10, 1010)]
    rows = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "ord bigint, text string")
    rows = rows.repartition(4)
    for n in (0, 1, 2, 3, 4, 999, 1000, 1001, 5000):
        got = [r["ord"] for r in CL.cap_first(rows, n).collect()]
        assert sorted(got, key=lambda k: (k is not None, k)) == keys[:n]
    copies = spark.createDataFrame([(5,)] * 50, "ord bigint").repartition(4)
    assert CL.cap_first(copies, 7).count() == 7
    assert CL.cap_first(copies.limit(0), 7).count() == 0


def test_turn_numbers_of_any_size(spark):
    rows = [(0, 0, "user", "one two three"), (0, 2_000_000_000, "assistant", "four five six"),
            (1, 1, "user", "one two three"), (1, 2, "assistant", "four five six"),
            (2, 0, "user", "one two three"), (2, 1, "assistant", "four five six")]
    data = turns(spark, rows)
    assert stats(CL.clean_turn_stats(data))["duplicate"] == 2
    assert [(r["ord"], len(r["messages"])) for r in CL.clean_turns(data).collect()] == [(0, 2)]


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant"]),
                                   st.text(max_size=30)), max_size=3), max_size=12))
def test_clean_against_a_plain_loop(spark, chats):
    seen, kept = set(), []
    for i, rows in enumerate(chats):
        trimmed = [(r, t.strip()) for r, t in rows]
        size = sum(len(t) for _, t in trimmed)
        if rows and any(t for _, t in trimmed) and 10 <= size <= 8192 and tuple(trimmed) not in seen:
            seen.add(tuple(trimmed))
            kept.append(i)
    data = records(spark, [chat(*c) for c in chats])
    once = CL.clean(data)
    assert sorted(r["ord"] for r in once.collect()) == kept
    assert CL.clean(once).count() == len(kept)
    got = stats(CL.clean_stats(data))
    assert got["removed"] == got["empty"] + got["too_short"] + got["too_long"] + got["duplicate"]


def test_profile(spark):
    data = records(spark, [chat(("user", "x" * 10), ("assistant", "y" * 40)),
                           chat(("user", "x" * 30), ("system", "z" * 2000))])
    for measures in (record_measures(data), turn_measures(record_turns(data))):
        row = role_length_stats(measures).first()
        assert (row.total_count, row.avg_user_length, row.avg_assistant_length) == (2, 20.0, 40.0)
        sizes = record_length_stats(measures).first()
        assert (sizes.min_total_length, sizes.max_total_length) == (50, 2030)
        buckets = {r.bucket: r.n for r in length_histogram(measures).collect()}
        assert buckets == {"0-50": 0, "50-200": 1, "200-500": 0, "500-1000": 0, "1000-2000": 0,
                           "2000+": 1}


def test_profile_of_nothing(spark):
    measures = record_measures(records(spark, []))
    assert role_length_stats(measures).first().total_count == 0
    assert record_length_stats(measures).first().max_total_length == 0
    assert language_hint(record_turns(records(spark, []))).first().language_hint == "en"


def test_language_hint(spark):
    for text, want in [("中文字符多 abc", "zh"), ("a" * 18 + "中国", "mixed"), ("a" * 40 + "中", "en")]:
        data = record_turns(records(spark, [chat(("user", text))]))
        assert language_hint(data).first().language_hint == want
    late = records(spark, [chat(("user", "a" * 50))] * 4 + [chat(("user", "中" * 900))])
    assert language_hint(record_turns(late), 4).first().language_hint == "en"
    assert language_hint(record_turns(late), None).first().language_hint == "zh"
