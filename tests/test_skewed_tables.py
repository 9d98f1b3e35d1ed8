"""Registered queries on tables with a hot user, a very long chat and many copies."""

import duckdb
import oracle
import pytest

from tuneprep.plans import ORACLES, QUERIES

SOURCE = "/root/testdata/sf0.001"
NAMES = [
    "clean_stats", "clean_chats", "clean_doc_stats", "dedup_exact", "assemble_chats",
    "conv_to_messages", "turns_to_alpaca", "role_length_stats", "length_histogram", "mix_pairs",
    "harvest_to_chats", "variant_expand", "metric_history", "log_tail", "parse_log_tail",
    "progress", "run_summary", "loss_deltas", "exp_detail", "exp_delete", "exp_update",
    "conv_to_alpaca", "messages_to_alpaca", "render_chat", "harvest_to_chats_all", "doc_prompts",
    "exp_insert", "stream_progress", "checkpoint_inventory", "list_datasets", "save_load",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()

    def write(name, sql):
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")

    for name in oracle.TABLES:
        if name not in ("events", "documents", "conversations"):
            write(name, f"SELECT * FROM '{SOURCE}/{name}.parquet'")
    write("events", f"""
        SELECT event_id + i * 100000 AS event_id, (ts + INTERVAL (i * 30) DAY)::TIMESTAMP AS ts,
               CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id, event_type, value,
               props
        FROM '{SOURCE}/events.parquet', range(4) r(i)""")
    write("documents", f"""
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'the same text in many copies' ELSE text END
                   AS text, lang, source, n_chars
        FROM '{SOURCE}/documents.parquet'""")
    write("conversations", f"""
        SELECT conv_id, turn, role, text FROM '{SOURCE}/conversations.parquet'
        UNION ALL
        SELECT 500, i, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END, 'turn ' || i
        FROM range(9000) r(i)
        UNION ALL
        SELECT 600 + j, i, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END, 'same copy ' || i
        FROM range(2) r(i), range(200) s(j)""")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query_on_skewed_tables(spark, skewed, name):
    con = oracle.connect(skewed)
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], skewed) is None
