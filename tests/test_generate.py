import pytest

from pyspark.sql import functions as F

from tuneprep.functions.harvest import find_records
from tuneprep.operators import generate as G

ITEM = '[{"instruction":"q","output":"a long enough answer"}]'


@pytest.mark.parametrize("text,count", [
    (f"text {ITEM} more", 1), ("no json", 0), (None, 0), ("", 0),
    (f"```json\n{ITEM}\n```", 1), (f"see [1] and [[2]], then {ITEM}", 1),
    ('```\n[{"question": "q"}]\n```', 1), ("[]", 0), ('[{"instruction": "q", "output": ', 0),
    ('[1, 2]', 2), ('[{"instruction": "has ] inside"}]', 1), (f"[[{ITEM}]]", 1), ("[" * 5000, 0),
])
def test_find_records(text, count):
    assert len(find_records(text)) == count


def test_harvest(spark):
    replies = spark.createDataFrame([(0, f"x {ITEM}"), (1, "none"), (2, "[1, 2]")],
                                    "reply_id bigint, text string")
    assert [(r.reply_id, r.instruction) for r in G.harvest(replies).collect()] == [(0, "q")]
    assert G.harvest(replies, min_answer=100).count() == 0
    assert G.harvest_to_chats(replies, target=5).count() == 1
    assert G.harvest_to_chats(replies, min_length=100).count() == 0


@pytest.mark.parametrize("target,counts", [(70, [30, 30, 10]), (30, [30]), (7, [7]), (0, [])])
def test_batches(spark, target, counts):
    rows = spark.createDataFrame([(target,)], "target_count bigint")
    assert [r["count"] for r in G.batch_plan(rows).orderBy("batch").collect()] == counts


def test_prompts(spark):
    rows = spark.createDataFrame([("code", 3, "{examples}", "[]"), ("odd", 4, "s", "[1]")],
                                 "data_type string, count int, scenario string, examples string")
    own = {"chat": "{count}|{scenario}|{examples}", "code": "C{count} {{x}} {scenario}"}
    assert [r.prompt for r in G.render_prompts(rows, own).collect()] == ["C3 {x} {examples}", "4|s|[1]"]


def test_document_prompts(spark):
    docs = spark.createDataFrame([("a" * 49,), ("b" * 50,), ("c" * 8001,)], "text string")
    got = G.document_prompts(docs, template="{document}").collect()
    assert [(r.chunk, len(r.prompt)) for r in got] == [(0, 50), (0, 8000), (1, 1)]
    small = G.document_prompts(docs, template="{document}", max_chars=30).collect()
    assert sum(len(r.prompt) for r in small) == 8051
    cut = G.document_prompts(docs, template="{document}", cut=True).collect()
    assert [len(r.prompt) for r in cut] == [50, 8000 + len(G.TRUNCATED)]


def test_routes(spark):
    rows = spark.createDataFrame([(0, "A CHAT and code helper"), (1, "nothing")],
                                 "ord bigint, description string")
    got = G.route_datasets(rows).collect()
    assert [r.rank for r in got if r.ord == 0] == [1, 2, 3, 4, 5]
    assert len([r for r in got if r.ord == 1]) == 2


def test_variants_and_mixing(spark):
    rows = spark.createDataFrame([(i, f"question number {i}", f"answer {i}") for i in range(6)],
                                 "ord bigint, instruction string, output string")
    grown = G.expand_variants(rows)
    assert grown.count() == 36 and grown.filter("variant = 0").count() == 6
    short = G.expand_variants(rows, dedup_chars=8)
    assert short.count() < 36
    pairs = G.mix_pairs(rows, seed=4).collect()
    assert len(pairs) == 6 and all(p.ord_a != p.ord_b for p in pairs)
    assert {p.ord_b for p in pairs} == set(range(6))
    assert G.mix_pairs(rows, target=2).count() == 2
    assert G.mix_pairs(rows.limit(1)).count() == 0


def test_mixing_is_a_seeded_permutation(spark):
    for n in (2, 3, 7, 64, 1000):
        numbers = spark.range(n).select("id", F.lit(n).cast("long").alias("n"))
        seen = set()
        for seed in (1, 2):
            rounds = G.swap_rounds(seed)
            out = numbers.select("id", "n", G.swapped(F.col("id"), F.col("n"), rounds).alias("x"))
            got = out.select("id", "x", G.swapped(F.col("x"), F.col("n"), rounds[::-1]).alias("back"))
            got = sorted(got.collect())
            assert sorted(r.x for r in got) == list(range(n))
            assert all(r.back == r.id for r in got)
            seen.add(tuple(r.x for r in got))
            # No shift of one another: the differences of neighbours take many values.
            steps = {(b.x - a.x) % n for a, b in zip(got, got[1:])}
            assert n < 64 or len(steps) > n // 4
        assert n < 7 or len(seen) == 2
    big = spark.range(10**15, 10**15 + 500).select(
        G.swapped(F.col("id"), F.lit(10**16), G.swap_rounds(3)).alias("x"))
    values = [r.x for r in big.collect()]
    assert len(set(values)) == 500 and all(0 <= x < 10**16 for x in values)


def test_no_row_meets_its_own_answer(spark):
    rows = spark.range(300).select(F.col("id").alias("ord"), F.concat(F.lit("q"), "id").alias("instruction"),
                                   F.concat(F.lit("a"), "id").alias("output"))
    for seed in (1, 5):
        pairs = G.mix_pairs(rows, seed=seed).collect()
        assert sorted(p.ord_a for p in pairs) == sorted(p.ord_b for p in pairs) == list(range(300))
        assert all(p.ord_a != p.ord_b for p in pairs)
        assert all(p.user == f"q{p.ord_a}" and p.assistant == f"a{p.ord_b}" for p in pairs)


def test_single_object_reply(spark):
    replies = spark.createDataFrame([(0, '```json\n{"question": "q", "answer": "a"}\n```')],
                                    "reply_id bigint, text string")
    assert G.harvest(replies).count() == 0
    assert [r.question for r in G.harvest(replies, single=True).collect()] == ["q"]
