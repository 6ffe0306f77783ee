from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from flowtally.llm.quality_rules import Condition, features, fit_rules, learn_list, op10_quality_rules, verdict

SMALL = "/root/testdata/sf0.001"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "x " * 50, "é𝒳 #*$ %&|<>\n\né𝒳 #*$\né𝒳 #*$\n \n ", "w\x0bv\x0cu\r\nt\tw v u t", "one two\n" * 300]


def test_features_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in features(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
    assert features(df.where("1 = 0")).count() == 0


def test_query_equals_brute_force_and_spares_good_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op10_quality_rules(spark, SMALL).collect()}
    assert {i: tuple(r[c] for c in BASE) for i, r in rows.items()} == {i: plain(t) for i, t in texts.items()}
    for r in rows.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()]
    assert all(rows[i].kept for i in good if not rows[i].base_failed)


def test_query_is_native(spark):
    plan = op10_quality_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_list_finds_a_planted_conjunction(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 100 / 100).alias("x"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 3 > 0).alias("grow")
    )
    rows = rows.withColumn("bad", ((F.col("x") > 0.8) & (F.col("y") <= 2)).cast("int"))
    rules = learn_list(rows, ("x", "y"))
    hit = rows.withColumn("rule", verdict(rules))
    wrong = hit.where((F.col("rule") > 0) != (F.col("bad") == 1)).count()
    assert rules and all(len(r) <= 3 for r in rules) and wrong < 60


def test_verdict_is_ordered_and_labels_may_miss(spark):
    rules = [[Condition("x", True, 5.0)], [Condition("x", True, 1.0), Condition("y", False, 0.0)]]
    df = spark.createDataFrame([(9.0, 0.0), (2.0, 0.0), (2.0, 1.0), (None, None)], "x double, y double")
    assert [r[0] for r in df.select(verdict(rules)).collect()] == [1, 2, 0, 0]
    feats = features(spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string"))
    none = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert fit_rules(feats, none) == []
