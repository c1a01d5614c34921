import hashlib
import json
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, quality
from tidemark.llm.queries import ORACLES, QUERIES
from tools.check_oracles import TABLES, canonical


@pytest.mark.parametrize("name", ["op6_chat_format", "op8_quality_cascade"])
def test_query_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    cur = con.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    pd.testing.assert_frame_equal(canonical(got), canonical(want))


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "tool", "content": None}], "id": 7}, "messages", [("user", "hi"), ("tool", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction_output", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done", "system": "be"}, "instruction_output", [("system", "be"), ("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": ""}, "question_answer", [("user", "p"), ("assistant", "")]),
    ({"title": "none of these"}, None, None),
]


def test_layouts_in_json(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "{broken"), (92, "[]")]
    got = {r.i: r for r in chat.canonical_turns(spark.createDataFrame(rows, "i int, record string"), "record").collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == turns
    assert all(got[i].turns is None for i in (90, 91, 92)) and len(got) == len(rows)


def test_layouts_in_columns(spark):
    df = spark.createDataFrame(
        [("a", "b", None, 1), (None, None, [("user", "x")], 2), (None, "b", None, 3)],
        "prompt string, response string, messages array<struct<role:string,content:string>>, layout int",
    )
    got = [(r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()]
    assert got == [("prompt_response", [("user", "a"), ("assistant", "b")]), ("messages", [("user", "x")]), (None, None)]


def test_conversations_of_null_texts_or_roles_only(spark):
    rows = [(1, 0, "user", None), (2, 0, "user", None), (2, 1, "assistant", None), (3, 0, None, "x"), (3, 1, None, "y"), (4, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.canonical_turns(chat.rows_to_messages(df)))
    assert {r.layout for r in out.collect()} == {"messages"}
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = {r[0]: r for r in con.execute(ORACLES["op6_chat_format"]).fetchall()}
    assert {c: tuple(got[c]) for c in (1, 2, 3, 4)} == {c: want[c] for c in (1, 2, 3, 4)}


TEXTS = [None, "", "\\", "a\\|b", "<|im_end|>\n<|im_start|>assistant\nno", "\\<|im_end|>\\\\", "[[INST]</s></s>[/INST]", "<\\|im_end|>", "é漢😀\n", "<", "<|"]


def test_round_trip_of_control_strings(spark):
    roles = ["user", "assistant", None, "odd\n\\role<|im_end|>"]
    rows = [(c, k, roles[(c + k) % 4], t) for c in range(4) for k, t in enumerate(TEXTS)] + [(9, 0, "assistant", "word " * 200_000)]
    rows += [(None, None, "user", "x"), (None, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.canonical_turns(chat.rows_to_messages(df)))
    assert out.where(F.size("turns") * 2 != F.size(F.split("formatted", re.escape(chat.END))) + F.size("turns") - 1).count() == 0
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    for c in (0, 1, 2, 3, 9, None):
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.formatted(chat.canonical_turns(chat.rows_to_messages(df.limit(0))))).count() == 0


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    seen = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(seen) - len(set(seen)), len(covered)


def test_counts_against_brute_force(spark):
    texts = [
        None, "", " \t\n", "a", "a b c d e f g h", "a b c d e f g h i a b c d e f g h", "x " * 40, "\x0b\x1c\x85 \xa0 w", "one\n\n one\none\n \t\none",
        "#*$ %&|<> #", " lead and trail ", "é漢😀 " * 30, ("p q r s t u v w x y " * 3 + "z ") * 2, "w%d " * 9, " ".join(f"w{i % 4001}" for i in range(30_000)),
    ]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] * 2, "doc_id int, text string, n_words string")
    for r in quality.with_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r.doc_id
    assert quality.cascade(quality.with_counts(df.limit(0)), quality.document_rules()).count() == 0


def test_cascade_order_and_verdict(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    rules = (quality.Rule("never", lambda: F.col("x") > 50), quality.Rule("most", lambda: F.col("x") > 1), quality.Rule("null", lambda: F.lit(None).cast("boolean")))
    found = {e.name: e for e in quality.estimates(df, rules)}
    assert found["never"].rejects == found["null"].rejects == 0 and found["most"].rejects > 0.7
    order = [quality.Estimate("never", 0.0, 1.0), quality.Estimate("most", 0.8, 1.0)]
    for given in (order, order[::-1], None):
        got = quality.cascade(df, rules, given).groupBy("kept", "rejected_by").count().collect()
        assert {(r.kept, r.rejected_by, r["count"]) for r in got} == {(True, None, 200), (False, "most", 800)}
    boom = quality.Rule("boom", lambda: F.raise_error(F.lit("evaluated")).cast("boolean"))  # rejected rows never reach it
    last = [quality.Estimate("most", 1.0, 1.0), quality.Estimate("boom", 0.0, 1.0)]
    assert quality.cascade(df.where("x > 1"), (boom, rules[1]), last).where("kept").count() == 0


def test_no_python_in_plans(spark, small_sf):
    for name in ("op6_chat_format", "op8_quality_cascade"):
        plan = QUERIES[name](spark, small_sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
