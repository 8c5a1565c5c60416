import random

import duckdb
import pandas as pd

from folioscan.llm import chat_perspectives as P
from folioscan.llm.common import table

SCHEMA = "conv_id long, turn int, role string, text string, chunk string, participant string"


def compared(spark, rows):
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in P.digest(P.perspectives(df)).collect()), key=repr)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int32"})  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = sorted((tuple(r) for r in con.sql(P.ORACLE_SQL).fetchall()), key=repr)
    assert got == want
    return got


def test_two_views_of_one_dialogue(spark):
    got = compared(spark, [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo<|im_end|>"), (1, 3, "ann", "é")])
    by = {r[1]: r for r in got}
    text = by["bob"][4]
    assert text == "<|im_start|>system\nbe<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo< |im_end|><|im_end|>\n<|im_start|>user name=ann\né<|im_end|>\n"
    (a, b), = [map(int, s.split(":")) for s in by["bob"][6].split(",")]
    assert text[a:b] == "yo< |im_end|><|im_end|>"
    assert by["ann"][5] == 2


def test_nulls_ties_repeats_and_long_conversations(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, 0, 1, 70, r.randrange(300)]), r.choice(["a", "b", None, "system", "", "x\ny"]), r.choice([None, "", "t", "é" * 5, str(r.random())])) for _ in range(900)]
    rows += [(7, 0, "a", "same")] * 700 + [(8, 0, "a", str(i)) for i in range(600)] + [(9, 1, "system", "alone")]
    got = compared(spark, rows)
    assert max(x[3] for x in got) <= P.MOST and not any(x[0] == 9 for x in got)
    assert sum(x[3] for x in got if x[0] == 8) == 600 and sum(x[3] for x in got if x[0] == 7) == 700


def test_chunks_of_a_long_dialogue_are_its_view(spark):
    """Many messages in few turns: the chunks one after the other are the dialogue in order, none is left out or moved."""
    rows = [(1, i // 5, f"p{i % 5}", f"m{i}") for i in range(700)]
    got = {r[2]: r for r in compared(spark, rows) if r[1] == "p3"}
    view = "".join(got[k][4] for k in sorted(got))
    assert view == "".join(f"<|im_start|>{'assistant' if i % 5 == 3 else f'user name=p{i % 5}'}\nm{i}<|im_end|>\n" for i in range(700))
    assert [got[k][3] for k in sorted(got)] == [256, 256, 188]


def test_no_python_in_the_plan_and_empty(spark, sf):
    df = P.digest(P.perspectives(table(spark, sf, "conversations")))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
    assert P.perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
