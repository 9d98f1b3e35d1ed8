"""Projections of the star-schema tables onto the engine's inputs.

Each one exists twice: as a DataFrame (``Tables``) and as SQL text (``VIEWS``) for the
side-by-side check. All are row-wise, except ``pairs``, which is an equi-join on a unique key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.formats import assemble_chats

MODEL_NAMES = [
    "Qwen/Qwen2.5-7B-Instruct", "meta-llama/Llama-3.1-8B-Instruct",
    "deepseek-ai/DeepSeek-Coder-6.7B", "mistralai/Mistral-7B-v0.1", "google/gemma-2-2b-it",
    "Qwen2.5-1.5B", "THUDM/chatglm3-6b", "acme/unknown-chat-model", "acme/base-model",
    "01-ai/Yi-1.5-6B-Chat", "bigcode/starcoder2-3b", "acme/internlm2-llama2",
]
LICENCES = [
    "mit", "apache-2.0", "llama3", "qwen", "cc-by-nc-4.0", "cc-by-nd-4.0", None, "",
    "Limited License", "cc-by-nc-nd-4.0", " Proprietary ", "custom-ndx", "other",
]
ARCHITECTURES = ["", "qwen2", "custom-transformer", "Gemma2", "text-generation"]
CONFIG_TEMPLATES = [
    "<|im_start|>user\n{content}<|im_end|>\nmore", "User: {user_content}\n\nAssistant: more",
    "plain", "", None,
]
TASKS = ["chat", "code", "translation", "customer", "safety", "general", "other"]
LANGUAGES = ["zh", "en", "mixed", "fr"]
LEVELS = ["beginner", "intermediate", "advanced", "expert", "other"]
PRESET_NAMES = ["quick", "standard", "deep", "other"]
METHODS = ["lora", "qlora", "full", "auto"]
FILE_NAMES = [
    "model-00001.safetensors", "config.json", ".cache", "weights.bin", "sub/tokenizer.json",
    "weights.gguf", "README.md",
]
EPOCH_2024 = 1704067200


def pick(values: list, key: Column) -> Column:
    """Element of a constant list chosen by ``key`` modulo its length."""
    return F.get(F.array(*[F.lit(v) for v in values]).cast("array<string>"),
                 (key % len(values)).cast("int"))


def sql_pick(values: list, key: str) -> str:
    items = ", ".join("NULL" if v is None else sql_text(v) for v in values)
    return f"([{items}])[CAST(({key}) % {len(values)} AS BIGINT) + 1]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Tables:
    """DataFrame projections of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        # The tables hold zone-less UTC times; read them as such whatever the session says.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def turns(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("ord"), "turn", "role", F.col("text").alias("content")
        )

    def chats(self) -> DataFrame:
        return assemble_chats(self.turns())

    def conversations(self) -> DataFrame:
        who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt") \
            .otherwise(F.col("role"))
        return assemble_chats(self.turns().withColumn("role", who), ("from", "value"),
                              "conversations")

    def pairs(self) -> DataFrame:
        """User turns answered by the next turn, as instruction rows."""
        turns = self.turns()
        user = turns.filter(F.col("role") == "user").select(
            "ord", F.col("turn") + 1, F.col("content")
        ).toDF("conv", "turn", "instruction")
        reply = turns.filter(F.col("role") == "assistant").select(
            F.col("ord").alias("conv"), "turn", F.col("content").alias("output")
        )
        return user.join(reply, ["conv", "turn"]).select(
            (F.col("conv") * 1_000_000 + F.col("turn") - 1).alias("ord"), "instruction",
            F.lit("").alias("input"), "output",
        )

    def documents(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("ord"), "text", "lang", "source")

    def doc_records(self) -> DataFrame:
        message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
        return self.documents().select("ord", F.array(message).alias("messages"))

    def mixed(self) -> DataFrame:
        """Records of every shape in one table, by document number."""
        kind = F.col("ord") % 7

        def when(*kinds: int) -> Column:
            return F.when(kind.isin(*kinds), F.col("text"))

        message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
        turn = F.struct(F.lit("human").alias("from"), F.col("text").alias("value"))
        return self.documents().select(
            "ord",
            F.when(kind == 0, F.array(message)).alias("messages"),
            F.when(kind == 1, F.array(turn)).alias("conversations"),
            when(2).alias("instruction"), when(3).alias("input"), when(2, 3).alias("output"),
            when(4).alias("prompt"), when(4).alias("response"),
            when(5).alias("question"), when(5).alias("answer"), when(6).alias("query"),
        )

    def questions(self) -> DataFrame:
        """Raw question rows under three pairs of field names."""
        kind = F.col("ord") % 3
        out = self.pairs()
        names = [("question", "answer"), ("prompt", "response"), ("query", "reply")]
        columns = []
        for i, (q, a) in enumerate(names):
            columns += [F.when(kind == i, F.col("instruction")).alias(q),
                        F.when(kind == i, F.col("output")).alias(a)]
        return out.select("ord", *columns)

    def experiments(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        done = F.col("o_orderstatus") == "F"
        loss = F.when(done, F.col("o_totalprice") / 100000.0)
        created = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
        return o.select(
            F.concat(F.lit("exp_"), key.cast("string")).alias("id"),
            F.concat(F.lit("model_"), (F.col("o_custkey") % 25).cast("string")).alias("model_id"),
            F.concat(F.lit("Model "), (F.col("o_custkey") % 25).cast("string")).alias("model_name"),
            F.concat(F.lit("ds_"), F.col("o_orderpriority")).alias("dataset_name"),
            (key % 5000).alias("dataset_size"),
            pick(METHODS, key).alias("finetuning_type"),
            pick(PRESET_NAMES, key).alias("preset"),
            F.when(done, "completed").when(F.col("o_orderstatus") == "P", "running")
            .otherwise("failed").alias("status"),
            F.when(key % 4 == 0, "{}")
            .when(key % 4 == 1, F.concat(F.lit('{"lora_rank": '), (key % 64).cast("string"),
                                         F.lit(', "num_epochs": 7}')))
            .when(key % 4 == 2, F.concat(F.lit('{"num_train_epochs": '), (key % 9).cast("string"),
                                         F.lit(', "per_device_train_batch_size": 2}')))
            .otherwise('{"lora_alpha": 64, "chat_template": "chatml", "max_seq_length": 512}')
            .alias("config_json"),
            loss.alias("final_loss"),
            (loss * 0.5).alias("best_loss"),
            (key % 7200).cast("double").alias("training_duration_seconds"),
            (key % 24).cast("double").alias("vram_peak_gb"),
            created.alias("created_at"),
            created.alias("updated_at"),
            F.when(key % 3 == 0, '["kept", "best"]').otherwise("[]").alias("tags"),
        )

    def metrics(self) -> DataFrame:
        e = self.raw("events")
        key = F.col("event_id")
        elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_2024 * 1_000_000) / 1e6
        return e.select(
            F.concat(F.lit("exp_"), F.col("user_id").cast("string")).alias("experiment_id"),
            key.alias("ord"), (key + 1).alias("step"), (key / 1000.0).alias("epoch"),
            (F.col("value") / 100.0).alias("loss"), F.lit(2e-4).alias("learning_rate"),
            F.lit(1.5).alias("grad_norm"), elapsed.alias("elapsed_seconds"),
        )

    def log_lines(self) -> DataFrame:
        """JSON metrics, JSON without a loss, dictionary-style text and noise, by event."""
        key = F.col("event_id")
        loss = F.col("value").cast("decimal(12,2)").cast("string")
        step, text = (key + 1).cast("string"), F.lit
        kind = key % 8
        line = (
            F.when(kind.isin(0, 1, 2, 3), F.concat(
                text('{"step": '), step, text(', "epoch": '), (key % 50).cast("string"),
                text('.25, "loss": '), loss, text(', "learning_rate": 0.0002, "elapsed_seconds": '),
                (key * 5).cast("string"), text("}")))
            .when(kind == 4, F.concat(text('  {"loss": '), loss, text("} ")))
            .when(kind == 5, F.concat(text('{"eval_loss": '), loss, text(', "step": '), step,
                                      text("}")))
            .when(kind == 6, F.concat(
                text("{'loss': "), loss, text(", 'grad_norm': 0.5, 'learning_rate': 2e-05, 'epoch': "),
                (key % 50).cast("string"), text(".5}")))
            .otherwise(F.concat(text("noise "), F.col("props")))
        )
        return self.raw("events").select(
            F.concat(F.lit("exp_"), F.col("user_id").cast("string")).alias("experiment_id"),
            key.alias("ord"), line.alias("line"),
        )

    def trainer_lines(self) -> DataFrame:
        key = F.col("event_id")
        loss = F.col("value").cast("decimal(12,2)").cast("string")
        clock = F.concat((key % 24).cast("string"), F.lit(":00:0"), (key % 10).cast("string"))
        line = F.concat(
            F.lit('{"current_steps": '), (key + 1).cast("string"), F.lit(', "epoch": '),
            (key % 50).cast("string"), F.lit('.5, "elapsed_time": "'), clock, F.lit('"'),
            F.when(key % 3 != 2, F.concat(F.lit(', "loss": '), loss)).otherwise(""), F.lit("}"),
        )
        return self.raw("events").select(
            F.concat(F.lit("exp_"), F.col("user_id").cast("string")).alias("run_id"),
            key.alias("ord"), F.when(key % 11 == 10, "  ").otherwise(line).alias("line"),
        )

    def checkpoint_files(self) -> DataFrame:
        key = F.col("event_id")
        return self.raw("events").select(
            F.concat(
                F.lit("/exp/exp_"), F.col("user_id").cast("string"), F.lit("/checkpoint-"),
                (F.floor(key / 500) * 100).cast("string"), F.lit("/f"), key.cast("string"),
            ).alias("path"),
            (key % 997 * 1024).alias("length"),
            key.alias("modificationTime"),
        )

    def checkpoints(self) -> DataFrame:
        key = F.col("event_id")
        return self.raw("events").select(
            F.concat(F.lit("exp_"), F.col("user_id").cast("string")).alias("experiment_id"),
            (key * 10).alias("step"),
            F.concat(F.lit("/ckpt/"), key.cast("string")).alias("path"),
            (key % 997).cast("double").alias("size_mb"),
            (F.col("value") / 100.0).alias("loss"),
        )

    def models(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            F.concat(pick(MODEL_NAMES, key), F.lit("-"), key.cast("string")).alias("model_id"),
            key.alias("ord"),
            F.when(key % 2 == 0, "huggingface").otherwise("modelscope").alias("source"),
            (key * 7919 % 100003).alias("downloads"),
            (key * 31 % 1009).alias("likes"),
            F.array("p_type", "p_brand").alias("tags"),
            pick(LICENCES, key).alias("license"),
            pick(ARCHITECTURES, key).alias("architecture"),
            pick(CONFIG_TEMPLATES, key).alias("config_template"),
            F.col("p_size").cast("double").alias("params_b"),
            (F.col("p_size") * 2 + 0.5).alias("size_gb"),
            ((key * 7 % 97) / 2.0 + 2.0).alias("vram_gb"),
            (key * 13 % 30000).alias("dataset_size"),
            pick(PRESET_NAMES, key).alias("preset"),
            pick(METHODS, key).alias("finetuning_type"),
            F.when(key % 3 == 0, "{}")
            .when(key % 3 == 1, F.concat(F.lit('{"lora_rank": '), (key % 300).cast("string"),
                                         F.lit(', "max_seq_length": '), (key % 40 * 1000)
                                         .cast("string"), F.lit("}")))
            .otherwise('{"learning_rate": 0.02, "num_train_epochs": 0, "save_steps": 10}')
            .alias("custom_json"),
            F.col("p_name").alias("p_name"), F.col("p_brand").alias("p_brand"),
            F.col("p_type").alias("p_type"), F.col("p_size").cast("long").alias("p_size"),
        )

    def cards(self) -> DataFrame:
        """A card catalogue with one card per part."""
        return self.raw("part").select(
            F.col("p_partkey").alias("ord"),
            F.array(F.lower("p_name"), F.concat(F.lower("p_name"), F.lit("-"),
                                                F.col("p_size").cast("string"))).alias("patterns"),
            F.concat("p_name", F.lit(" "), F.col("p_brand")).alias("display_name"),
            F.lower("p_type").alias("family"),
            F.col("p_size").cast("double").alias("params_b"),
            F.array("p_type", "p_brand").alias("tags"),
        )

    def searches(self) -> DataFrame:
        """Result rows of many searches, each row from one of three origins."""
        return self.models().select(
            F.concat("p_name", F.lit("/"), F.col("p_brand")).alias("search_id"),
            F.when(F.col("p_size") <= 12, "online").when(F.col("p_size") <= 30, "cache")
            .otherwise("local").alias("origin"),
            "model_id", "downloads",
        )

    def requests(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("request_id"),
            pick(TASKS, key).alias("task"),
            pick(LANGUAGES, F.col("c_nationkey")).alias("language"),
            pick(LEVELS, key).alias("level"),
            ((key * 7 % 97) / 2.0 + 2.0).alias("vram_gb"),
        )

    def files(self) -> DataFrame:
        """A file listing of a model library, one file per line item."""
        part, line = F.col("l_partkey"), F.col("l_linenumber").cast("long")
        folder = F.replace(pick(MODEL_NAMES, part), F.lit("/"), F.lit("--"))
        return self.raw("lineitem").select(
            F.concat(F.lit("/models/"), folder, F.lit("-"), part.cast("string"), F.lit("/"),
                     pick(FILE_NAMES, F.col("l_orderkey") + line)).alias("path"),
            (F.col("l_quantity") * 1048576).cast("long").alias("length"),
        )

    def model_configs(self) -> DataFrame:
        key = F.col("p_partkey")
        folder = F.replace(pick(MODEL_NAMES, key), F.lit("/"), F.lit("--"))
        return self.raw("part").select(
            F.concat(folder, F.lit("-"), key.cast("string")).alias("model_dir"),
            F.when(key % 5 == 4, "not json").otherwise(F.concat(
                F.lit('{"model_type": "'), F.lower("p_type"), F.lit('", "hidden_size": '),
                (F.col("p_size") * 64).cast("string"), F.lit(', "license": "mit"}'),
            )).alias("config"),
        )

    def replies(self) -> DataFrame:
        """Model replies wrapping the pairs: prose, fenced, broken, none, nested, other keys."""

        def js(column: str) -> Column:
            """JSON string literal of a text column."""
            wrapped = F.to_json(F.array(column))
            return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)

        q, a = js("instruction"), js("output")
        item = F.concat(F.lit('[{"instruction": '), q, F.lit(', "output": '), a, F.lit("}]"))
        other = F.concat(F.lit('[{"question": '), q, F.lit(', "answer": '), a, F.lit("}]"))
        kind = F.col("ord") % 6
        text = (
            F.when(kind == 0, F.concat(F.lit("Here you go: "), item, F.lit(" done")))
            .when(kind == 1, F.concat(F.lit("```json\n"), item, F.lit("\n```")))
            .when(kind == 2, F.concat(F.lit('[{"instruction": '), q, F.lit(', "output": ')))
            .when(kind == 3, F.lit("no data"))
            .when(kind == 4, F.concat(F.lit("see [note 1] and [[1, 2]], then "), item))
            .otherwise(F.concat(F.lit("```\n"), other, F.lit("\n```")))
        )
        return self.pairs().select(F.col("ord").alias("reply_id"), text.alias("text"))

    def sample_logs(self) -> DataFrame:
        """A prediction log per document: as many samples as its number modulo five."""
        body = F.replace(F.replace("text", F.lit('"'), F.lit("'")), F.lit("\\"), F.lit("/"))
        block = F.transform(F.sequence(F.lit(0), F.col("ord") % 5), lambda i: F.when(
            i > 0, F.concat(
                F.lit("predict_"), (F.col("ord") * 10 + i).cast("string"),
                F.lit(' {"x": 1,\n"input": "'), body, F.lit('",\n"predict": "p'),
                i.cast("string"), F.lit('", "label": "'), body, F.lit('"}\n'),
            )).otherwise("start\n"))
        return _spread(self.documents()).select(F.col("ord").alias("log_id"),
                                                F.array_join(block, "").alias("text"))

    def sample_lines(self) -> DataFrame:
        """The lines of the prediction logs."""
        return self.sample_logs().select(
            "log_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before they are multiplied; tables of more partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# SQL text of the same projections -----------------------------------------------------------

_EXP = "'exp_' || user_id"
_CLOCK = "(event_id % 24) || ':00:0' || (event_id % 10)"
_LOSS = "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"

VIEWS = {
    "v_turns": "SELECT conv_id AS ord, turn, role, text AS content FROM conversations",
    "v_pairs": """
        SELECT u.conv_id * 1000000 + u.turn AS ord, u.text AS instruction, '' AS input,
               a.text AS output
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "v_docs": "SELECT doc_id AS ord, text, lang, source FROM documents",
    "v_experiments": f"""
        SELECT 'exp_' || o_orderkey AS id, 'model_' || (o_custkey % 25) AS model_id,
               'Model ' || (o_custkey % 25) AS model_name, 'ds_' || o_orderpriority AS dataset_name,
               o_orderkey % 5000 AS dataset_size,
               {sql_pick(METHODS, "o_orderkey")} AS finetuning_type,
               {sql_pick(PRESET_NAMES, "o_orderkey")} AS preset,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running'
                    ELSE 'failed' END AS status,
               CASE o_orderkey % 4 WHEN 0 THEN '{{}}'
                    WHEN 1 THEN '{{"lora_rank": ' || (o_orderkey % 64) || ', "num_epochs": 7}}'
                    WHEN 2 THEN '{{"num_train_epochs": ' || (o_orderkey % 9)
                                || ', "per_device_train_batch_size": 2}}'
                    ELSE '{{"lora_alpha": 64, "chat_template": "chatml", "max_seq_length": 512}}'
               END AS config_json,
               CASE WHEN o_orderstatus = 'F' THEN o_totalprice / CAST(100000 AS DOUBLE) END
                   AS final_loss,
               CASE WHEN o_orderstatus = 'F' THEN o_totalprice / CAST(100000 AS DOUBLE)
                    * CAST(0.5 AS DOUBLE) END AS best_loss,
               CAST(o_orderkey % 7200 AS DOUBLE) AS training_duration_seconds,
               CAST(o_orderkey % 24 AS DOUBLE) AS vram_peak_gb,
               epoch(o_orderdate) AS created_at, epoch(o_orderdate) AS updated_at,
               CASE WHEN o_orderkey % 3 = 0 THEN '["kept", "best"]' ELSE '[]' END AS tags
        FROM orders""",
    "v_metrics": f"""
        SELECT {_EXP} AS experiment_id, event_id AS ord, event_id + 1 AS step,
               event_id / CAST(1000 AS DOUBLE) AS epoch, value / CAST(100 AS DOUBLE) AS loss,
               CAST(0.0002 AS DOUBLE) AS learning_rate, CAST(1.5 AS DOUBLE) AS grad_norm,
               (epoch_us(ts) - {EPOCH_2024}000000) / CAST(1000000 AS DOUBLE) AS elapsed_seconds
        FROM events""",
    "v_log_lines": f"""
        SELECT {_EXP} AS experiment_id, event_id AS ord,
               CASE WHEN event_id % 8 IN (0, 1, 2, 3) THEN
                        '{{"step": ' || (event_id + 1) || ', "epoch": ' || (event_id % 50)
                        || '.25, "loss": ' || {_LOSS}
                        || ', "learning_rate": 0.0002, "elapsed_seconds": ' || (event_id * 5) || '}}'
                    WHEN event_id % 8 = 4 THEN '  {{"loss": ' || {_LOSS} || '}} '
                    WHEN event_id % 8 = 5 THEN
                        '{{"eval_loss": ' || {_LOSS} || ', "step": ' || (event_id + 1) || '}}'
                    WHEN event_id % 8 = 6 THEN
                        '{{''loss'': ' || {_LOSS}
                        || ', ''grad_norm'': 0.5, ''learning_rate'': 2e-05, ''epoch'': '
                        || (event_id % 50) || '.5}}'
                    ELSE 'noise ' || props END AS line
        FROM events""",
    "v_trainer_lines": f"""
        SELECT {_EXP} AS run_id, event_id AS ord,
               CASE WHEN event_id % 11 = 10 THEN '  ' ELSE
                   '{{"current_steps": ' || (event_id + 1) || ', "epoch": ' || (event_id % 50)
                   || '.5, "elapsed_time": "' || {_CLOCK} || '"'
                   || CASE WHEN event_id % 3 <> 2 THEN ', "loss": ' || {_LOSS} ELSE '' END || '}}'
               END AS line
        FROM events""",
    "v_checkpoint_files": f"""
        SELECT '/exp/' || {_EXP} || '/checkpoint-' || (event_id // 500 * 100) || '/f' || event_id
                   AS path,
               event_id % 997 * 1024 AS length, event_id AS modified
        FROM events""",
    "v_checkpoints": f"""
        SELECT {_EXP} AS experiment_id, event_id * 10 AS step, '/ckpt/' || event_id AS path,
               CAST(event_id % 997 AS DOUBLE) AS size_mb, value / CAST(100 AS DOUBLE) AS loss
        FROM events""",
    "v_models": f"""
        SELECT {sql_pick(MODEL_NAMES, "p_partkey")} || '-' || p_partkey AS model_id,
               p_partkey AS ord,
               CASE WHEN p_partkey % 2 = 0 THEN 'huggingface' ELSE 'modelscope' END AS source,
               p_partkey * 7919 % 100003 AS downloads, p_partkey * 31 % 1009 AS likes,
               [p_type, p_brand] AS tags, {sql_pick(LICENCES, "p_partkey")} AS license,
               {sql_pick(ARCHITECTURES, "p_partkey")} AS architecture,
               {sql_pick(CONFIG_TEMPLATES, "p_partkey")} AS config_template,
               CAST(p_size AS DOUBLE) AS params_b,
               CAST(p_size AS DOUBLE) * 2 + CAST(0.5 AS DOUBLE) AS size_gb,
               CAST(p_partkey * 7 % 97 AS DOUBLE) / 2 + 2 AS vram_gb,
               p_partkey * 13 % 30000 AS dataset_size,
               {sql_pick(PRESET_NAMES, "p_partkey")} AS preset,
               {sql_pick(METHODS, "p_partkey")} AS finetuning_type,
               p_partkey % 3 AS custom_kind, p_partkey % 300 AS custom_rank,
               p_partkey % 40 * 1000 AS custom_seq,
               p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size
        FROM part""",
    "v_cards": """
        SELECT p_partkey AS ord, [lower(p_name), lower(p_name) || '-' || p_size] AS patterns,
               p_name || ' ' || p_brand AS display_name, lower(p_type) AS family,
               CAST(p_size AS DOUBLE) AS params_b, [p_type, p_brand] AS tags
        FROM part""",
    "v_searches": """
        SELECT p_name || '/' || p_brand AS search_id,
               CASE WHEN p_size <= 12 THEN 'online' WHEN p_size <= 30 THEN 'cache' ELSE 'local' END
                   AS origin,
               model_id, downloads
        FROM v_models""",
    "v_requests": f"""
        SELECT c_custkey AS request_id, {sql_pick(TASKS, "c_custkey")} AS task,
               {sql_pick(LANGUAGES, "c_nationkey")} AS language,
               {sql_pick(LEVELS, "c_custkey")} AS level,
               CAST(c_custkey * 7 % 97 AS DOUBLE) / 2 + 2 AS vram_gb
        FROM customer""",
    "v_files": f"""
        SELECT '/models/' || replace({sql_pick(MODEL_NAMES, "l_partkey")}, '/', '--') || '-'
               || l_partkey || '/' || {sql_pick(FILE_NAMES, "l_orderkey + l_linenumber")} AS path,
               CAST(l_quantity * 1048576 AS BIGINT) AS length
        FROM lineitem""",
}


def sql_with_views(sql: str) -> str:
    """Prefix the view definitions a statement uses, in dependency order."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(VIEWS[name])

    visit(sql)
    definitions = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in used)
    if not definitions:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH "):
        return f"WITH {definitions},\n{body[5:]}"
    return f"WITH {definitions}\n{body}"
