from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowtally.llm.base import words_of
from flowtally.llm.mixing import allot, fit_exponent, mix, op8_mix_sources

SMALL = "/root/testdata/sf0.001"


def plain_exponent(tokens, test, low, high):
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if test(mid, tokens) else (low, mid)
    return high


def weights(tokens, a):
    raw = {s: (t / sum(tokens.values())) ** a for s, t in tokens.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values() if x)


TOKENS = {"a": 9000, "b": 700, "c": 250, None: 50}


def shares(spark, tokens):
    rows = [(s, t, t / sum(tokens.values())) for s, t in tokens.items()]
    return spark.createDataFrame(rows, "src string, tokens long, share double")


@pytest.mark.parametrize("share", [0.3, 0.8, 0.95])
def test_exponent_meets_entropy(spark, share):
    a, _ = fit_exponent(shares(spark, TOKENS), 10000.0, entropy=share * math.log(4))
    expected = plain_exponent(TOKENS, lambda x, t: entropy(weights(t, x)) > share * math.log(4), 0.0, 16.0)
    assert a == pytest.approx(expected, abs=1e-6)
    assert entropy(weights(TOKENS, a)) == pytest.approx(share * math.log(4), abs=1e-5)


def test_exponent_meets_repetition_limit_with_and_without_budget(spark):
    a, budget = fit_exponent(shares(spark, TOKENS), 10000.0, max_repeat=3.0)
    assert max(budget * w / TOKENS[s] for s, w in weights(TOKENS, a).items()) == pytest.approx(3.0, rel=1e-6)
    a, budget = fit_exponent(shares(spark, TOKENS), None, max_repeat=1.5)
    due = [budget * w / TOKENS[s] for s, w in weights(TOKENS, a).items()]
    assert min(due) == pytest.approx(1.0) and max(due) == pytest.approx(1.5, rel=1e-6)
    assert fit_exponent(shares(spark, TOKENS), 10000.0, entropy=math.log(4))[0] == 0.0


def rows_of(spark):
    rows, k = [], 0
    for s, t in TOKENS.items():
        for _ in range(t // 25):
            rows.append((k, s, 20 + k % 11, "x"))
            k += 1
    rows.append((k, "empty", 0, "x"))
    return spark.createDataFrame(rows, "doc_id long, source string, n int, rows string").withColumn("full", F.lit(1))


def test_draw_meets_budgets(spark):
    df = rows_of(spark)
    drawn = mix(df, F.col("n"), 8000.0, entropy_share=0.9, max_repeat=6.0, block_rows=16)
    assert drawn.columns == [*df.columns, "_epoch", "_block", "_row"]
    have, used, copies = Counter(), Counter(), defaultdict(Counter)
    for r in df.collect():
        have[r.source] += r.n
    for r in drawn.collect():
        used[r.source] += r.n
        copies[r.source][r.doc_id] += 1
    a, _ = fit_exponent(shares(spark, {s: t for s, t in have.items() if t}), 8000.0, entropy=0.9 * math.log(4), max_repeat=6.0)
    for s, w in weights({s: t for s, t in have.items() if t}, a).items():
        # over by less than the row that reaches the budget
        assert 8000 * w - 1e-6 <= used[s] < 8000 * w + 31
        drawn_of = [copies[s][r.doc_id] for r in df.where(F.col("source").eqNullSafe(F.lit(s))).collect()]
        assert max(drawn_of) - min(drawn_of) <= 1
    assert copies["empty"] == {df.count() - 1: 1}
    # the same draw whatever the partitioning
    again = mix(df.repartition(7), F.col("n"), 8000.0, entropy_share=0.9, max_repeat=6.0, block_rows=16)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, drawn.collect()), key=str)


def test_whole_epochs_come_first(spark):
    df = rows_of(spark)
    drawn = mix(df, F.col("n"), None, max_repeat=2.5, block_rows=16)
    first = drawn.where("_epoch = 0")
    assert first.count() == df.count() == first.select("doc_id").distinct().count()
    assert drawn.agg(F.max("_epoch")).first()[0] == 2


def test_query_is_native_and_whole(spark):
    df = op8_mix_sources(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = df.collect()
    have, used = Counter(), Counter()
    for r in rows:
        have[r.source] += r.n_tokens
        used[r.source] += r.n_tokens * r.copies
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    a, budget = fit_exponent(shares(spark, have), float(sum(have.values())), 0.97 * math.log(len(have)), 4.0)
    largest = max(r.n_tokens for r in rows)
    for s, w in weights(have, a).items():
        assert budget * w - 1e-6 <= used[s] <= budget * w + largest


def test_null_tokens_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a", None), (None, "a", 5), (2, None, 5), (2, None, 5)], "doc_id long, source string, n int")
    drawn = mix(df, F.col("n"), None, max_repeat=2.0)
    assert drawn.where("_epoch = 0").count() == 4
    assert mix(df.where("1 = 0"), F.col("n"), None, max_repeat=2.0).collect() == []
    assert mix(df.where("n IS NULL"), F.col("n"), 10.0, entropy_share=0.5).count() == 1


def test_each_repeated_row_has_its_own_copies(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 5)], "doc_id long, source string, n int")
    given = allot(df, F.col("n"), 15.0)
    assert sorted((r.doc_id, r._copies) for r in given.collect()) == [(1, 1), (1, 1), (2, 1)]
    half = allot(df.where("source = 'a'"), F.col("n"), 5.0).collect()
    assert sorted(r._copies for r in half) == [0, 1]


def test_rows_without_ids_are_spread_over_blocks(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), "id", F.lit(3).alias("n"))
    sizes = [r["count"] for r in allot(df, F.col("n"), block_rows=100).groupBy("_mix_b").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 200


def test_clashing_and_dotted_names(spark):
    df = spark.createDataFrame([(1, "a", 5, "p", "q")], ["doc_id", "source", "n", "a.b", "_mix_key"])
    drawn = mix(df, F.col("n"), 5.0)
    assert drawn.columns == ["doc_id", "source", "n", "a.b", "_epoch", "_block", "_row"] and drawn.first()["a.b"] == "p"


def test_a_very_long_text_is_one_row(spark):
    df = spark.createDataFrame([(1, "a", "w " * 1_000_000), (2, "a", "w")], "doc_id long, source string, text string")
    assert mix(df, F.size(words_of(F.col("text")))).groupBy("doc_id").count().collect().__len__() == 2
