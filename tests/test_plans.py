from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from flowtally.plans import (
    PRESETS,
    ChangeDetectionSpec,
    IncrementalSpec,
    ModelSpec,
    PipelineSpec,
    ScdSpec,
    Step,
    apply_preset,
    apply_steps,
    backfill_window,
    cdc_apply,
    incremental_filter,
    incremental_load,
    late_arrival_scd2,
    materialize,
    preset_dedup,
    register_preset,
    run_pipeline,
    scd2_apply,
    scd2_initial,
    with_run_ts,
)
from tests.conftest import rows


def _spec(**kw):
    return ScdSpec("scd2", ("id",), ChangeDetectionSpec(kw.pop("strategy", "hash"), ("a", "b")), **kw)


@pytest.mark.parametrize("strategy", ["hash", "column_compare"])
def test_scd2_versions(spark, strategy):
    spec = _spec(strategy=strategy, surrogate_key="sk")
    first = spark.createDataFrame(
        [(1, "x", None), (2, "x", "y"), (3, None, None), (4, "a|", "b")], "id int, a string, b string"
    )
    target = scd2_initial(first, spec, "2024-01-01 00:00:00")
    staged = spark.createDataFrame(
        [(1, "x", "new"), (2, "x", "y"), (3, None, None), (4, "a", "|b"), (5, "n", "n")], "id int, a string, b string"
    )
    out = scd2_apply(target, staged, spec, "2024-02-01 00:00:00")
    assert out.columns == target.columns
    got = rows(out.select("id", "b", "is_current", F.date_format("end_dt", "yyyy-MM-dd")))
    assert got == rows(
        spark.createDataFrame(
            [
                (1, None, False, "2024-02-01"),
                (1, "new", True, "9999-12-31"),
                (2, "y", True, "9999-12-31"),
                (3, None, True, "9999-12-31"),
                (4, "b", False, "2024-02-01"),
                (4, "|b", True, "9999-12-31"),
                (5, "n", True, "9999-12-31"),
            ],
            "id int, b string, c boolean, e string",
        )
    )
    # the same load again changes nothing, and surrogate keys are unique
    again = scd2_apply(out, staged, spec, "2024-03-01 00:00:00")
    assert rows(again) == rows(out)
    assert out.select("sk").distinct().count() == out.count()


def test_scd2_rejects_duplicate_keys_unless_ordered(spark):
    spec = _spec()
    target = scd2_initial(spark.createDataFrame([(1, "x", "y")], "id int, a string, b string"), spec, "2024-01-01")
    twice = spark.createDataFrame([(1, "p", "q"), (1, "r", "s")], "id int, a string, b string")
    with pytest.raises(Exception, match="duplicate merge key"):
        scd2_apply(target, twice, spec, "2024-02-01").collect()
    got = scd2_apply(target, twice, spec, "2024-02-01", order_by=["a"])
    assert rows(got.where("is_current").select("a")) == [("r",)]
    with pytest.raises(ValueError):
        scd2_apply(target, twice, ScdSpec("scd1", ("id",), spec.change_detection), "2024-02-01")
    with pytest.raises(ValueError):
        ChangeDetectionSpec("hash", ())


def test_cdc(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame(
        [(1, "D", None, 1), (2, "U", "B1", 1), (2, "U", "B2", 2), (4, "D", None, 1), (5, "I", "E", 1), (3, "D", None, 1), (3, "I", "C", 2)],
        "k int, op string, v string, o int",
    )
    out = cdc_apply(target, changes, ["k"], ["o"])
    assert rows(out) == [(2, "B2"), (3, "C"), (5, "E")]
    assert rows(cdc_apply(out, changes, ["k"], ["o"])) == rows(out)


def test_rank_filter_runs_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = preset_dedup(df, "k", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_incremental(spark):
    source = spark.createDataFrame([(1, 10), (2, 20), (2, 20), (3, None)], "k int, w int")
    empty = source.limit(0)
    assert incremental_filter(source, empty, "w").count() == 4
    target = spark.createDataFrame([(9, 10)], "k int, w int")
    assert rows(incremental_filter(source, target, "w")) == [(2, 20), (2, 20)]
    assert rows(incremental_load(target, source, IncrementalSpec("w"))) == [(2, 20), (9, 10)]
    loaded = incremental_load(target, source, IncrementalSpec("w", deduplicate=False))
    assert loaded.count() == 3
    again = incremental_load(loaded, source, IncrementalSpec("w"))
    assert rows(again) == rows(loaded)
    for kind in ("timestamp", "timestamp_ntz", "date", "string", "double", "decimal(12,3)"):
        values = ["2024-03-31 02:30:00.123456", "2024-10-27 02:30:00"] if kind != "date" else ["2024-03-31", "2024-10-27"]
        if kind in ("double", "decimal(12,3)"):
            values = ["0.1", "0.3"]
        t = spark.createDataFrame([(v,) for v in values], "w string").select(F.col("w").cast(kind).alias("w"))
        assert rows(incremental_filter(t, t.orderBy("w").limit(1), "w")) == rows(t.orderBy(F.desc("w")).limit(1))
        assert incremental_filter(t, t, "w").count() == 0
    with pytest.raises(ValueError):
        IncrementalSpec("")
    assert rows(backfill_window(target.union(source), 10, 20, "w").select("w").distinct()) == [(10,), (20,)]


def test_materialize_dispatch(spark):
    src = spark.createDataFrame([(1, "x", "y")], "id int, a string, b string")
    cols = ("id", "a", "b")
    assert rows(materialize(ModelSpec("t", "full", cols), src, src.limit(0))) == [(1, "x", "y")]
    scd1 = ModelSpec("t", "scd1", cols, scd=ScdSpec("scd1", ("id",), ChangeDetectionSpec("hash", ("a",))))
    old = spark.createDataFrame([(1, "o", "o"), (2, "k", "k")], "id int, a string, b string")
    assert rows(materialize(scd1, src, old)) == [(1, "x", "y"), (2, "k", "k")]
    scd2 = ModelSpec("t", "scd2", cols, scd=_spec())
    assert materialize(scd2, src, scd2_initial(old, _spec(), "2024-01-01"), "2024-02-01").count() == 3
    inc = ModelSpec("t", "incremental", cols, incremental=IncrementalSpec("id"))
    assert materialize(inc, src, old.limit(0)).count() == 1
    for bad in (ModelSpec("t", "odd", cols, scd=_spec()), ModelSpec("t", "scd2", cols), ModelSpec("t", "incremental", cols)):
        with pytest.raises(ValueError):
            materialize(bad, src, old)


def test_late_rows_close_and_reopen(spark):
    h = spark.createDataFrame(
        [(1, "2024-01-01", "a"), (1, "2024-03-01", "c"), (1, "2024-02-01", "late"), (2, "2024-01-01", "z")],
        "id int, d string, v string",
    ).select("id", F.col("d").cast("timestamp").alias("effective_dt"), "v")
    out = late_arrival_scd2(h, ["id"])
    got = rows(out.select("v", F.date_format("end_dt", "yyyy-MM-dd"), "is_current"))
    assert got == [
        ("a", "2024-02-01", False),
        ("c", "9999-12-31", True),
        ("late", "2024-03-01", False),
        ("z", "9999-12-31", True),
    ]


def test_presets_and_steps(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "p int, v string")

    def run(name, **kw):
        return apply_preset(df, PipelineSpec("j", partition_column="p", preset=name, **kw))

    for name in ("generic", "enterprise_a", "enterprise_b", "copy", "nope", "join"):
        assert rows(run(name)) == rows(df)
    assert rows(run("filter")) == [(1, "a"), (1, "b")]
    assert rows(run("dedup")) == [(None, "c"), (1, "a")]
    assert run("cast").dtypes == [("p", "string"), ("v", "string")]
    spark.createDataFrame([(1, "L")], "p int, l string").createOrReplaceTempView("lk")
    assert rows(run("join", metadata={"lookup_table": "lk"})) == [(None, "c", None), (1, "a", "L"), (1, "b", "L")]
    register_preset("upper", lambda d, s: d.withColumn("v", F.upper("v")))
    assert rows(run("upper").select("v")) == [("A",), ("B",), ("C",)]
    del PRESETS["upper"]
    out = apply_steps(
        df,
        [
            Step("s1", "select", {"cols": ["p", "v"]}),
            Step("f", "filter", {"condition": "p is not null"}),
            Step("lk", "join", {"on": "p", "how": "left"}),
            Step("a", "aggregate", {"group_by": ["l"]}),
        ],
        {"lk": spark.table("lk")},
    )
    assert rows(out) == [("L", 2)]
    with pytest.raises(ValueError):
        apply_steps(df, [Step("x", "explode")])
    assert rows(with_run_ts(df, "2024-01-01").select(F.year("run_ts")).distinct()) == [(2024,)]


def test_run_pipeline(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    src, dst = f"{root}/src", f"{root}/dst"
    spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "k int, v string, d string").write.parquet(src)
    spec = dict(job_name="j", source_table=src, partition_column="d")
    run_pipeline(spark, PipelineSpec(target_table=dst, write_mode="overwrite", **spec))
    assert run_pipeline(spark, PipelineSpec(target_table=dst, write_mode="append", **spec)).count() == 4
    assert run_pipeline(spark, PipelineSpec(target_table=dst, write_mode="overwrite", **spec)).count() == 2
    merged = PipelineSpec(target_table=f"{root}/m", write_mode="merge", merge_keys=("k",), **spec)
    assert run_pipeline(spark, merged).count() == 2
    spark.createDataFrame([(2, "B", "d2"), (3, "c", "d3")], "k int, v string, d string").write.mode("overwrite").parquet(src)
    assert rows(run_pipeline(spark, merged).select("k", "v")) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError):
        run_pipeline(spark, PipelineSpec(target_table=dst, write_mode="upsert", **spec))
    for bad in (dict(job_name="a b"), dict(job_name="a", source_table="x"), dict(job_name="a", partition_column=" ")):
        with pytest.raises(ValueError):
            PipelineSpec(**bad)
