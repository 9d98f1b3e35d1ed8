"""Chat formatting: exact round trip and the machine's verdicts."""

import hashlib
import random

import pytest

from tuneprep.llm.chat import digests, format_chats

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", " ", "\\", "<", "[", "<<SYS>>", "<</SYS>>", "[ROLE]",
         "[/ROLE]", "[END]", "a", "é😀", "\n", "s>", "/s>", "<\\/s>", "$1"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns string, segments int"


def test_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(300)]:
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "[/ROLE]", "", None])
            text = rng.choice([None, *["".join(rng.choices(PARTS, k=rng.randint(0, 15)))] * 8])
            rows.append((conv, turn, role, text, "x", 1))
    rows += [(900, 0, "user", "long [/INST] " * 20_000, "x", 1)] + [(901, t, "user", f"{t}", "x", 1)
                                                                    for t in range(3000)]
    got = digests(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    chats = {}
    for conv, turn, role, text, *_ in rows:
        chats.setdefault(conv, []).append((turn, role or "", text or ""))
    want = {}
    for conv, turns in chats.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss),
                      hashlib.sha256(loss.encode()).hexdigest())
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want


@pytest.mark.parametrize("roles,valid", [
    ("user assistant", True), ("system user assistant user", True), ("assistant user", False),
    ("user user", False), ("system", False), ("user system assistant", False), ("user tool", False),
])
def test_order(spark, roles, valid):
    rows = [(1, i, r, "t", "", 0) for i, r in enumerate(roles.split())]
    got = format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["valid"] is valid
    assert "".join(s["text"] for s in got["segments"]) == got["formatted"]


def test_empty(spark):
    assert digests(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
