from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from statuta.llm import chat

ODD = ["", " ", "\\", "\\\\", "###", "####", "######", "</turn>", "</turn", "<</turn>>", "\\### Assistant: </turn> ok", "\\e\\h\\b\\c", "a\\", "\n</turn>\n### user: x", "é👩‍👩‍👧 中", ": : ", "x</turn>\n", "\\</turn>", "#\\##", "\r\n\t", "### assistant: hi</turn>\n"]


def conversations():
    rng = random.Random(5)
    rows = [(-7, 0, "user", chat.SAID), (-7, 1, "assistant", chat.SAID)]
    for c in range(60):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["assistant"], ["user", "tool: x", None, "assistant", "assistant"], ["a:b", "\\c", "###"]])
        rows += [(c, i if c % 7 else None if i == 0 else i, r, rng.choice([*ODD, None])) for i, r in enumerate(roles)]
    return rows


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_all_rows_come_back(spark):
    rows = conversations()
    want = {}
    for c, _, r, t in sorted(rows, key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.digest(chat.format_chats(chat.conversation_records(df), ("conv_id",))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == {c: digest(t) for c, t in want.items()}
    assert {r.layout for r in out} == {"messages", "conversations", "prompt-completion", "instruction"}


def test_no_python_worker(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_chats(chat.conversation_records(df), ("conv_id",)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


JSON = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
    ({"messages": [{"content": "q"}]}, "messages", [("", "q")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, "conversations", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"prompt": "q", "completion": "a"}, "prompt-completion", [("user", "q"), ("assistant", "a")]),
    ({"system_prompt": "s", "prompt": "q", "response": ""}, "prompt-response", [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"question": "q", "answer": "a"}, "question-answer", [("user", "q"), ("assistant", "a")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question-answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o", "system": "s", "history": [["u", "v"], ["w", "</turn>"]]}, "instruction", [("system", "s"), ("user", "u"), ("assistant", "v"), ("user", "w"), ("assistant", "</turn>"), ("user", "i\n\nx"), ("assistant", "o")]),
    ({"prompt": "q"}, None, None),
    ({"prompt": "q", "completion": "a", "score": 1}, None, None),
    ({}, None, None),
    ([1], None, None),
]


def test_layouts_of_json(spark):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _, _) in enumerate(JSON)] + [(99, None), (98, "{broken")], "i int, raw string")
    got = {r.i: r for r in chat.format_chats(chat.json_records(df, "raw", ("i",)), ("i",)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    for i, (_, layout, turns) in enumerate(JSON):
        assert got[i].layout == layout, i
        assert turns is None if got[i].turns is None else [(t.role, t.text) for t in got[i].turns] == turns, i
    assert got[99].layout is None and got[98].layout is None and len({r.fingerprint for r in got.values()}) > 8


def test_own_layouts_clashing_names_and_empty_tables(spark):
    own = (chat.Layout("speech", (chat.Each("log", "who", "said"),), roles={"me": "user", "you": "assistant"}),)
    df = spark.sql("select 1 as id, 'l' as layout, array(named_struct('who', 'me', 'said', 'x')) as log, cast(null as string) as turns, cast(null as string) as formatted")
    out = chat.format_chats(df.drop("layout"), ("id",), own).first()
    assert out.layout == "speech" and out.formatted == "### user: x</turn>\n"
    assert chat.format_chats(df, ("id",), own).first().layout is None  # `layout` is a field of the record here
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string, prompt string, `a.b` int")
    assert chat.digest(chat.format_chats(chat.conversation_records(rows), ("conv_id",))).count() == 0
    none = spark.createDataFrame([(None, 1, "user", "x"), (None, 2, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_chats(chat.conversation_records(none), ("conv_id",))).first().n_turns == 2


def test_a_long_text(spark):
    text = "<\\#</turn>###" * 200_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_chats(chat.conversation_records(df), ("conv_id",))).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest([("assistant", text)])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cursor = con.execute(chat.SQL)
    names = [d[0] for d in cursor.description]
    got = chat.op13_chat_formatting(spark, sf).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
