import hashlib
import random

from pyspark.sql import functions as F
from schedulesmith.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_round_trip_of_control_strings(spark):
    rnd = random.Random(1)
    parts = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<", "|", "\\", "<\\|", "assistant", "\n", "é", " ", "<|", "$1", "user"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "".join(rnd.choices(parts, k=rnd.randrange(12)))) for c in range(60) for t in range(4)]
    rows += [(100, 0, "<|im_sep|>\n", "x"), (101, None, None, None), (None, 1, "user", "n")]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as segments", "2 as formatted")
    formatted = chat.format_conversations(turns)
    got = {r[0]: [tuple(x) for x in r[1]] for r in formatted.select("conv_id", chat.read_turns(F.col("formatted"))).collect()}
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    digest = {r.conv_id: r for r in chat.chat_digest(formatted).collect()}
    for c, turns_of in want.items():
        loss = "".join(t for role, t in turns_of if role == "assistant")
        assert digest[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[c].loss_chars == len(loss)
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns_of).encode()).hexdigest()


def test_state_machine(spark):
    cases = {1: "system user assistant", 2: "user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user", 6: "user assistant system", 7: "tool"}
    rows = [(c, i, role, "t") for c, roles in cases.items() for i, role in enumerate(roles.split())]
    got = {r.conv_id: (r.valid, r.first_bad_turn) for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 2), 7: (False, 0)}


def test_ties_repeated_rows_and_no_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "z")]
    turns = spark.createDataFrame(rows, SCHEMA)
    text = chat.format_conversations(turns).first().formatted
    assert [x for x in text if x in "abz"][-1] == "b" and text.startswith("<|im_start|>system<|im_sep|>z<|im_end|>") and text.count("<|im_sep|>a") == 2
    assert chat.chat_digest(chat.format_conversations(turns.limit(0))).count() == 0
