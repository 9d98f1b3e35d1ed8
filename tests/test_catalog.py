import dataclasses

import pytest
from pyspark.sql import functions as F

from tuneprep.functions import catalog as C
from tuneprep.functions import sizing as S
from tuneprep.operators import budget as B
from tuneprep.operators import catalog as K
from tuneprep.operators import recommend as R
from tuneprep.rules.cards import BUILTIN_DATASETS, default_cards, load_cards


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw,want", [
    ("", "unknown"), (None, "unknown"), ("gpl", "unknown"),                  # no rule
    ("  Proprietary ", "forbidden"), ("All-Rights-Reserved", "forbidden"),   # class lists
    ("research-only, see file", "restricted"), ("CC-BY-NC-SA-3.0", "restricted"),
    ("BSD-3-Clause", "commercial"), ("Limited", "commercial"), ("OpenRAIL++", "commercial"),
    ("house-nc-1", "restricted"), ("cc-by-nc-nd-4.0", "restricted"), ("x-nd", "forbidden"),  # hints
    ("proprietary bsd", "forbidden"), ("research-only bsd", "restricted"),   # order of the lists
])
def test_licence(spark, raw, want):
    assert one(spark, raw, C.licence_class) == want


@pytest.mark.parametrize("model,arch,want", [
    ("lab/one", "gemma2", True), ("lab/two", "mistral", True), ("lab/three", "llama", True),
    ("lab/four", "qwen2", True), ("lab/five", "two-tower", False), ("lab/six", "LLAMA", True),
])
def test_compatibility(spark, model, arch, want):
    row = spark.createDataFrame([(model, arch)], "m string, a string").select(
        C.compatibility(F.col("m"), F.col("a")).alias("c")).first().c
    assert row.supported is want


@pytest.mark.parametrize("model,name", [
    ("mirror--chatglm3-6b--int4", "ChatGLM3-6B"), ("lab/QWEN2.5-1.5B.q4", "Qwen2.5-1.5B-Instruct"),
    ("lab/qwen2.5-7b-own-tune", "Qwen2.5-7B-Instruct"), ("", None), ("lab/nothing-like-it", None),
])
def test_card_match(spark, model, name):
    got = K.with_card(spark.createDataFrame([(model,)], "model_id string")).first()
    assert got.card_name == name


@pytest.mark.parametrize("model,vram,method", [
    ("lab/qwen2.5-7b-own", 5.9, "insufficient"), ("lab/qwen2.5-7b-own", 6.0, "qlora"),
    ("lab/qwen2.5-7b-own", 16.0, "lora"), ("lab/qwen2.5-7b-own", 40.0, "full"),
    ("lab/nothing-like-it", 1.0, "qlora"),
])
def test_best_method(spark, model, vram, method):
    rows = spark.createDataFrame([(model, vram)], "model_id string, vram_gb double")
    got = K.best_method(rows).first()
    assert got.recommended_method == method
    assert (got.config is None) == (method == "insufficient")


@pytest.mark.parametrize("model,template", [
    ("own/gemma-tiny", "gemma"), ("own/mistral-q4", "mistral"), ("own/qwen-tiny", "chatml"),
    ("own/deepseek-tiny", "deepseek"), ("own/nothing", "chatml"), ("own/phi4-x", "phi"),
])
def test_template(spark, model, template):
    got = K.detect_templates(spark.createDataFrame([(model,)], "model_id string")).first()
    assert got.template_name == template


def test_template_longest_and_config(spark):
    rows = spark.createDataFrame([("microsoft/phi4", "[INST] {user_content} [/INST] {assistant")],
                                 "model_id string, config string")
    assert K.detect_templates(rows, longest=True).first().template_name == "phi4"
    got = K.detect_templates(rows, "config").first()
    assert (got.template_name, got.source) == ("mistral", "config")


def test_card_table(spark, tmp_path):
    cards = K.card_table(spark)
    assert cards.count() == len(default_cards()) == 26
    assert K.search_cards(cards, tag="中文").count() >= 4
    assert K.search_cards(cards, query="7B", min_params=6, max_params=8).count() >= 2
    assert K.search_cards(cards, query="llama").count() >= 1
    assert "qwen2" in [r.family for r in K.families(cards).collect()]
    first = {r.family: r.display_name for r in K.lookup_first(cards, "family", "display_name").collect()}
    assert "Qwen" in first["qwen2"] and "DeepSeek" in first["deepseek"]
    file = tmp_path / "cards.json"
    file.write_text('[{"id": "a", "patterns": ["zz"], "display_name": "A", "family": "f", '
                    '"chat_template": "chatml", "params_b": 1, "size_gb": 2, "license": "mit", '
                    '"training": {"qlora": {"min_vram_gb": 3, "lr": 0.1, "batch_size": 1, '
                    '"max_seq_length": 8}}}]')
    assert [c.id for c in load_cards(spark, str(file))] == ["a"]
    assert len(load_cards(spark)) == 26
    with pytest.raises(Exception, match="none.json"):
        load_cards(spark, str(tmp_path / "none.json"))
    file.write_text("{}")
    with pytest.raises(ValueError):
        load_cards(spark, str(file))
    assert len({d[2] for d in BUILTIN_DATASETS}) >= 3
    assert K.builtin_datasets(spark).count() == 10
    assert {r.id for r in K.builtin_datasets(spark, "客服").collect()} == {"ecs-zh", "gcq-zh"}


def test_recommendation(spark):
    rows = spark.createDataFrame(
        [("a", "chat", "zh", "intermediate", 12.0), ("b", "chat", "en", "expert", 2.0)],
        "id string, task string, language string, level string, vram_gb double")
    got = R.recommend(rows, 5).orderBy("id", "rank").collect()
    assert [(r.id, r.rank) for r in got] == [("a", i) for i in range(1, 6)]
    scores = [r.score for r in got]
    assert scores == sorted(scores, reverse=True)
    assert got[0].display_name == "Qwen2.5-7B-Instruct" and got[0].score == 35 + 20 + 15 + 10 + 5
    assert "7.0B 参数" in got[0].reason and "显存充裕（需 6GB，有 12GB）" in got[0].reason


def test_recommendation_for_unknown_keys_and_other_cards(spark):
    schema = "id string, task string, language string, level string, vram_gb double"
    rows = spark.createDataFrame([
        ("known", "chat", "zh", "intermediate", 24.0), ("none", None, None, "intermediate", 24.0),
        ("other", "x", "x", "intermediate", 24.0), ("level", "chat", "zh", None, 24.0),
        ("memory", "chat", "zh", "expert", None), ("small", "chat", "zh", "expert", 0.5)], schema)
    got = {}
    for r in R.recommend(rows, 50).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.display_name, r.score, r.method))
    assert got["none"] == got["other"] == got["known"]
    assert {n for n, _, _ in got["level"]} == {n for n, _, _ in got["known"]}
    points = dict((n, s) for n, s, _ in got["known"])
    assert all(points[n] - s in (5.0, 10.0) for n, s, _ in got["level"])
    assert "memory" not in got and "small" not in got
    cards = default_cards()
    bare = dataclasses.replace(cards[0], training={"full": cards[0].training["full"]})
    only = R.recommend(rows, 50, [bare, cards[1]]).collect()
    assert {r.display_name for r in only} == {cards[1].display_name}


@pytest.mark.parametrize("params,method,batch,seq,want", [
    (7.0, "qlora", 2, 1024, [3.26, 0.39, 0.36, 0.00, 0.99, 5.00]),
    (7.0, "lora", 2, 2048, [13.04, 0.39, 0.72, 0.00, 2.46, 16.61]),
    (7.0, "full", 2, 2048, [13.04, 39.12, 0.72, 0.00, 2.46, 55.33]),
    (1.5, "lora", 4, 2048, [2.79, 0.08, 0.58, 0.00, 0.92, 4.38]),
])
def test_memory_budget(spark, params, method, batch, seq, want):
    row = spark.createDataFrame([(params,)], "p double")
    parts = S.memory_budget(F.col("p"), F.lit(method), F.lit("bf16"), F.lit(batch), F.lit(seq))
    got = row.select(*[c.alias(n) for n, c in parts.items()]).first()
    assert [round(v, 2) for v in got] == want


def test_quantised_sizes(spark):
    got = B.quantised_sizes(spark.createDataFrame([(14.5,)], "size_gb double")).collect()
    assert [round(r.estimated_size_gb, 2) for r in got] == [4.21, 4.93, 5.8, 7.83, 14.5]


def test_config_defaults_and_audit(spark):
    rows = spark.createDataFrame(
        [("Qwen/x", 7.0, 12.0, 500, "auto", "quick", '{"lora_rank": 300}', "/m", "")],
        "model_id string, params_b double, vram_gb double, dataset_size bigint, "
        "finetuning_type string, preset string, custom_json string, model_path string, "
        "dataset_path string")
    got = B.audit_config(B.resolve_config(rows)).first()
    assert (got.finetuning_type, got.lora_rank, got.save_steps, got.chat_template) == \
        ("qlora", 300, 500, "chatml")
    assert set(got.issues) >= {"dataset_path missing", "lora_rank out of range"}
    assert not got.valid


def test_globs(spark):
    files = spark.createDataFrame([("a/model.safetensors",), ("a/w.bin",), ("a/x1.txt",)], "path string")
    assert {r.path for r in K.filter_files(files).collect()} == {"a/model.safetensors", "a/x1.txt"}
    assert K.filter_files(files, allow=["x?.t*", "*.bin"], ignore=[]).count() == 2
