from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from flowtally.llm.chat import PART, format_conversations, loss_text, op6_chat_format, read_turns, text_part

SMALL = "/root/testdata/sf0.001"
ODD = "\\### Assistant: </turn> ok"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark):
    conversations = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        conversations[r.conv_id].append((r.turn, r.role, r.text or ""))
    conversations[-7] = [(0, "user", ODD), (1, "assistant", ODD)]
    rows = op6_chat_format(spark, SMALL).collect()
    assert {r.conv_id for r in rows} == set(conversations)
    for r in rows:
        turns = sorted(conversations[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(said), len(loss), sha(loss))
        assert r.formatted_chars >= len(said)


def test_query_is_native(spark):
    plan = op6_chat_format(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_control_strings_round_trip(spark):
    texts = [ODD, "\\", "\\\\h", "\\l", "###", "####", "</turn>\n### user: x</turn>\n", "<|image|>", "é𝒳\n", "", None, "a" * 100000]
    rows = [(1, i, role, t) for i, t in enumerate(texts) for role in ("user", "assistant")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("body", F.lit(1))
    out = format_conversations(df.withColumn("content", text_part(F.col("text"))))
    r = out.select(read_turns(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"), "formatted").first()
    expected = sorted((i, role, t or "") for _, i, role, t in rows)
    assert [(x.role, x.text) for x in r.t] == [(role, t) for _, role, t in expected]
    assert r.l == "".join(t or "" for t in texts)
    assert r.formatted.count("</turn>\n") == len(rows)


def test_typed_parts(spark):
    parts = [
        [("text", "see </tu", None, None, None, None, None), ("image", None, "i1", 56, 57, None, None), ("text", "rn> and", None, None, None, None, None)],
        [("audio", None, "a1", None, None, 1.01, None), ("document", None, "d1", None, None, None, 3), ("video", "x", "v", 1, 1, 1.0, 1), None],
        None,
        [("image", None, None, None, None, None, None)],
    ]
    rows = [(1, 0, "user", parts[0]), (1, 1, "assistant", parts[1]), (1, 2, "assistant", parts[2]), (1, 3, "tool: a", parts[3])]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, content array<{PART}>")
    r = format_conversations(df).withColumn("t", read_turns(F.col("formatted"))).first()
    assert [(x.role, x.text) for x in r.t] == [
        ("user", "see </tu<|image|>rn> and"),
        ("assistant", "<|audio|><|document|>"),
        ("assistant", ""),
        ("tool: a", "<|image|>"),
    ]
    assert [(a.turn_no, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (1, "image", "i1", 2 * 3),
        (2, "audio", "a1", 26),
        (2, "document", "d1", 768),
        (4, "image", None, 0),
    ]
    assert r.expanded_tokens == 6 + 26 + 768
    spans = [r.formatted[s.start : s.start + s["size"]] for s in r.loss_spans]
    assert spans == ["<|audio|><|document|>", ""]


def test_nulls_ties_and_nothing(spark):
    rows = [(None, None, None, "b"), (None, None, None, "a"), (None, 1, "assistant", None), (2, 1, "user", "x"), (2, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("content", text_part(F.col("text")))
    out = format_conversations(df).withColumn("t", read_turns(F.col("formatted")))
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in out.collect()}
    assert got == {None: [("", "a"), ("", "b"), ("assistant", "")], 2: [("user", "x"), ("user", "x")]}
    assert format_conversations(df.where("1 = 0")).collect() == []
