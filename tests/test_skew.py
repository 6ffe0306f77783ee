from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowtally import skew
from flowtally.skew import (
    CHUNK,
    NEVER,
    may_have_hot_key,
    range_chunks,
    with_chunk,
    with_next,
    with_position,
    with_previous,
    with_running,
)
from tests.conftest import rows


def _hot(spark, n=4000):
    # key 0 holds most of the rows; ties on ts are broken by id; key NULL exists
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 7, F.lit(0)).when(F.col("id") % 10 == 9, F.lit(None)).otherwise(F.col("id") % 5)
        .cast("int").alias("k"),
        ((F.col("id") * 7919 % n).cast("int") / 3).cast("int").alias("ts"),
        "id",
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id")).alias("v"),
    )


def test_chunks_split_only_hot_keys(spark):
    got = with_chunk(_hot(spark), ["k"], "ts", min_rows=500).groupBy("k", "__hot").agg(
        F.countDistinct("__chunk").alias("c")
    )
    found = {(r.k, r["__hot"]): r.c for r in got.collect()}
    assert found[(0, True)] == 6
    assert all(c == 1 for (k, hot), c in found.items() if not hot)
    assert with_chunk(_hot(spark), ["k"], "ts") is None


def test_unskewed_keys_get_the_plain_window(spark):
    plan = with_previous(_hot(spark), ["k"], ["ts", "id"], {"p": "v"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_previous_and_next_match_plain_windows(spark):
    df = _hot(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("k", "id", F.lag("v").over(w).alias("p"), F.lag("id").over(w).alias("q"))
    got = with_previous(df, ["k"], ["ts", "id"], {"p": "v", "q": "id"}, chunk_rows=100).select("k", "id", "p", "q")
    assert rows(got) == rows(want)
    want = df.select("k", "id", F.lead("v").over(w).alias("p"))
    got = with_next(df, ["k"], ["ts", "id"], {"p": "v"}, chunk_rows=100).select("k", "id", "p")
    assert rows(got) == rows(want)


def test_running_sum_and_position_match_plain_windows(spark):
    df = _hot(spark)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    got = with_running(df, ["k"], ["ts", "id"], {"s": "v"}, chunk_rows=100)
    got = with_position(got, ["k"], ["ts", "id"], "n", chunk_rows=100).select("k", "id", "s", "n")
    assert rows(got) == rows(want)


def test_one_time_for_all_rows_is_cut_too(spark):
    """A key whose rows share the first order column: borders go through the second."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.lit(5).alias("ts"),
        F.when(F.col("id") % 7 > 0, F.col("id") * 31 % 3001).alias("seq"),
        "id",
    )
    order = ["ts", "seq", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("q"), F.row_number().over(w).alias("n"))
    got = with_previous(df, ["k"], order, {"p": "id"}, chunk_rows=50)
    got = with_next(got, ["k"], order, {"q": "id"}, chunk_rows=50)
    got = with_position(got, ["k"], order, "n", chunk_rows=50)
    assert rows(got.select("id", "p", "q", "n")) == rows(want)


@pytest.mark.parametrize("n", [2000, 16000])
def test_chunks_stay_small_whatever_the_table(spark, n):
    chunks = range_chunks(_hot(spark, n), ["k"], ["ts", "id"], 500, n)
    sizes = [r["count"] for r in chunks.groupBy(CHUNK).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 500 and len(sizes) <= 4 * n // 500 + 1
    # chunks follow the order: no two overlap
    ends = chunks.groupBy(CHUNK).agg(F.min(F.struct("k", "ts", "id")).alias("lo"), F.max(F.struct("k", "ts", "id")).alias("hi"))
    last = Window.orderBy(CHUNK)
    assert ends.withColumn("before", F.lag("hi").over(last)).where("before >= lo").count() == 0


def test_chunks_have_a_most_number(spark, monkeypatch):
    monkeypatch.setattr("flowtally.skew.MOST_CHUNKS", 6, raising=False)
    df = _hot(spark, 3000)
    chunks = range_chunks(df, ["k"], ["ts", "id"], 50, 3000)
    assert chunks.rdd.getNumPartitions() <= 6
    got = with_position(df, ["k"], ["ts", "id"], "n", chunk_rows=50).select("id", "n")
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_first(), "id")
    assert rows(got) == rows(df.select("id", F.row_number().over(w).alias("n")))


def test_hot_keys_are_told_from_many_small_ones(spark):
    small = spark.range(60_000).select(F.col("id").alias("k"), F.col("id").alias("ts"))
    # too many keys for the sketch, so they are counted
    assert may_have_hot_key(small, ["k"], 10) == (False, 60_000)
    some = small.withColumn("k", F.when(F.col("ts") % 100 == 0, F.lit(-1)).otherwise(F.col("k")))
    assert may_have_hot_key(some, ["k"], 10) == (True, 60_000)
    assert may_have_hot_key(some, ["k"], 700) == (False, 60_000)
    assert may_have_hot_key(some.where("1 = 0"), ["k"], 10) == (False, 0)
    null = some.withColumn("k", F.lit(None).cast("long"))
    assert may_have_hot_key(null, ["k"], 10) == (True, 60_000)


def test_keys_of_several_columns_and_nulls(spark):
    df = _hot(spark).withColumn("k2", F.when(F.col("id") % 2 == 0, F.lit("a")))
    w = Window.partitionBy("k", "k2").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"))
    got = with_running(df, ["k", "k2"], ["ts", "id"], {"s": "v"}, chunk_rows=80).select("id", "s")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("chunk_rows", [500, 1_000_000, NEVER])
def test_windows_are_dealt_by_rows_not_by_bytes(spark, monkeypatch, chunk_rows):
    df = _hot(spark).withColumn("seq", F.col("id"))
    want = with_running(with_previous(df, ["k"], ["ts", "id"], {"p": "v"}), ["k"], ["ts", "id"], {"s": "v"})
    monkeypatch.setattr(skew, "TASK_ROWS", 300)
    asked = []
    plain = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *by: asked.append(n) or plain(self, n, *by))
    got = with_running(
        with_previous(df, ["k"], ["ts", "id"], {"p": "v"}, chunk_rows=chunk_rows), ["k"], ["ts", "id"], {"s": "v"}, chunk_rows=chunk_rows
    )
    # 4000 rows in tasks of 300: rows that compress well are not put together beyond that
    assert asked == [14, 14]
    assert rows(got) == rows(want)
