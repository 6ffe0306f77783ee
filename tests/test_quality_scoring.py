from __future__ import annotations

import pytest

from flowtally.quality import (
    check_duplicates,
    check_freshness,
    check_null_threshold,
    column_catalog,
    infer_rules,
    run_checks,
    suggest_checks,
    validate_rules,
)
from flowtally.scoring import (
    approval_required,
    cost_cloud,
    cost_cluster,
    cost_columns,
    cost_preflight,
    decide_execution,
    decide_preflight,
    decide_thresholds,
    job_sizing,
    join_advice,
    partition_advice,
    risk_plan,
    risk_preflight,
    spec_policy,
    tuning_hints,
)
from tests.conftest import rows


def test_rules_and_checks(spark):
    df = spark.createDataFrame([(1, -1.0, "a"), (2, None, None), (2, 3.0, None)], "k int, v double, s string")
    got = run_checks(df, ["k", "s"], ["v"], {"s": 0.5, "v": 0.5})
    assert rows(got) == [
        ("non_negative", "v", 1, 3, False), ("not_null", "k", 0, 3, True), ("not_null", "s", 2, 3, False),
        ("null_threshold", "s", 2, 3, False), ("null_threshold", "v", 1, 3, True),
    ]
    assert check_null_threshold(df.limit(0), {"s": 0.0}).first().passed is True
    assert rows(check_duplicates(df, ["k"])) == [(2, 2)]
    ts = spark.sql("select timestamp'2024-01-01 00:00:00' ts")
    assert check_freshness(ts, "ts", "2024-01-01 00:30:00", 30).first().passed is True
    assert check_freshness(ts, "ts", "2024-01-01 00:31:00", 30).first().passed is False
    assert check_freshness(ts.limit(0), "ts", "2024-01-01", 30).first().passed is False
    rules = infer_rules(column_catalog(spark, {"t": df}))
    assert rows(rules) == [
        ("t", "k", "non_negative"), ("t", "k", "not_null"), ("t", "s", "not_null"),
        ("t", "v", "non_negative"), ("t", "v", "not_null"),
    ]
    odd = spark.createDataFrame([("not_null", None), ("not_null", "a"), ("non_negative", None)], "rule_type string, column_name string")
    assert rows(validate_rules(odd).select("rule_type", "status", "reason")) == [
        ("non_negative", "valid", None), ("not_null", "invalid", "missing column"), ("not_null", "valid", None),
    ]
    assert validate_rules(odd).where("status = 'invalid'").count() == 1
    m = spark.createDataFrame([("scd2", 3), ("full", 0)], "model_type string, column_count int")
    assert [r.checks for r in suggest_checks(m).collect()] == [
        ["freshness_check", "duplicate_check", "null_threshold_check"], ["freshness_check"],
    ]
    with pytest.raises(ValueError):
        run_checks(df)


def test_preflight(spark):
    jobs = spark.createDataFrame(
        [("a", 50.0, 2.0, 1.0, 4, 120), ("b", 500.0, 5.0, 5.0, 2, 10), ("c", 1.0, 1.0, 1.0, 2, None)],
        "job_name string, estimated_input_gb double, shuffle_multiplier double, cost_per_executor_hour double, executors int, max_runtime_minutes int",
    )
    got = decide_preflight(risk_preflight(cost_preflight(jobs)))
    assert rows(got.select("job_name", "runtime_minutes", "compute_cost_usd", "confidence", "risk_score", "decision")) == [
        ("a", 125.0, 8.33, 0.7, 0.4, "WARN"),
        ("b", 6250.0, 1041.67, 0.6, 1.0, "BLOCK"),
        ("c", 2.5, 0.08, 0.85, 0.0, "ALLOW"),
    ]


def test_plan_scores(spark):
    jobs = spark.createDataFrame(
        [(3, 1, 200, 10, 0.25, 8), (40, 5, 400, 10, 1.0, 4)],
        "num_stages int, shuffle_stages int, base_parallelism int, executor_instances int, instance_hourly_rate double, executor_memory_gb int",
    )
    got = tuning_hints(risk_plan(cost_cluster(jobs)))
    assert rows(got.select("runtime_minutes", "cost_estimate_usd", "risk_score", "risk_level", "failure_probability", "confidence_score")) == [
        (10.5, 0.44, 0, "LOW", 0.0, 1.0), (57.5, 9.58, 45, "MEDIUM", 0.45, 0.7),
    ]
    assert [len(r.hints) for r in got.collect()] == [0, 3]
    limits = dict(max_cost_usd=5.0, max_risk_score=40, max_failure_probability=0.4, min_confidence_score=0.8)
    for mode, want in (("strict", ["ALLOW", "BLOCK"]), ("balanced", ["ALLOW", "BLOCK"]), ("permissive", ["ALLOW", "WARN"])):
        assert [r.decision for r in decide_thresholds(got, limits, mode).collect()] == want
    soft = dict(limits, max_cost_usd=50.0, max_risk_score=90, max_failure_probability=1.0)
    assert [r.decision for r in decide_thresholds(got, soft, "balanced").collect()] == ["ALLOW", "WARN"]
    with pytest.raises(ValueError):
        decide_thresholds(got, limits, "odd")


def test_cloud_cost(spark):
    jobs = spark.createDataFrame(
        [("aws", "us-east-1", "m5", 2, 4.0, False, 30.0), ("aws", None, None, 0, 0.1, True, 0.0)],
        "provider string, region string, instance_type string, executors int, vcpu_per_executor double, spot boolean, runtime_minutes double",
    )
    got = cost_cloud(jobs).orderBy("executors").collect()
    assert (got[1].compute_cost_usd, got[1].infra_cost_usd, got[1].estimated_total_cost_usd, got[1].cost_confidence) == (0.18, 0.0144, 0.1944, 0.8)
    # 0.00015 is a tie: Spark rounds half up where Python's round gives 0.0001
    assert (got[0].compute_cost_usd, got[0].cost_confidence) == (0.0002, 0.7)


def test_execution_policy(spark):
    jobs = spark.createDataFrame(
        [
            ("ok", "m", 1.0, 10.0, 2, 0.1), ("ok", "m", 60.0, 200.0, 300, 0.9), ("ok", "m", 1.0, 10.0, 2, 0.7),
            ("near", "m", 1.0, 1.0, 1, None), ("full", "m", 1.0, 1.0, 1, None), ("over", "m", 2.0, 1.0, 1, None),
            ("new", "m", None, None, None, None),
        ],
        "tenant string, month string, estimated_total_cost_usd double, runtime_minutes double, executors int, risk_score double",
    )
    ledger = spark.createDataFrame([("near", "m", 79.0), ("full", "m", 100.0), ("over", "m", 99.0)], "tenant string, month string, estimated_cost_usd double")
    budgets = spark.createDataFrame([("near", 100.0), ("full", 100.0), ("over", 100.0)], "tenant string, limit_usd double")
    got = decide_execution(jobs, ledger, budgets)
    found = sorted((r.tenant, r.decision, ",".join(n.code for n in [*r.reasons, *r.warnings])) for r in got.collect())
    assert found == [
        ("full", "BLOCK", "exec.budget.exceeded"),
        ("near", "WARN", "exec.budget.near_limit"),
        ("new", "ALLOW", ""),
        ("ok", "ALLOW", ""),
        ("ok", "BLOCK", "exec.cost.too_high,exec.runtime.too_high,exec.executors.too_high,exec.risk.high"),
        ("ok", "WARN", "exec.risk.high"),
        ("over", "BLOCK", "exec.budget.exceeded"),
    ]
    text = [n.message for r in got.where("tenant = 'near'").collect() for n in r.warnings]
    assert text == ["Monthly budget near limit for m: projected=$80.00 (80%) of limit=$100.00."]


def test_small_scores(spark):
    j = spark.createDataFrame([(None,), (0.7,), (0.69,)], "risk_score double")
    assert [(r.required, r.approval_reason) for r in approval_required(j).collect()] == [
        (False, "risk_score_missing"), (True, "high_risk_requires_approval"), (False, "risk_below_threshold"),
    ]
    s = spark.createDataFrame(
        [("a", "o", "d.t", "d.t"), ("b", "", "dt", "x"), ("c", None, "d.t", None)],
        "job_name string, owner string, source_table string, target_table string",
    )
    assert rows(spec_policy(s)) == [
        ("b", "FAIL", "SOURCE_TABLE_INVALID"), ("b", "WARN", "OWNER_MISSING"),
        ("c", "FAIL", "TARGET_TABLE_INVALID"), ("c", "WARN", "OWNER_MISSING"),
    ]
    z = spark.createDataFrame([(3.0, 1, 0), (60.0, 3, 20), (49.9, 2, 45)], "data_gb double, joins int, sla_minutes int")
    assert rows(job_sizing(z).drop("data_gb", "joins", "sla_minutes")) == [
        (12, 6, "14g", 240, True), (2, 4, "8g", 200, False), (9, 4, "8g", 200, False),
    ]
    c = spark.createDataFrame(
        [("t", "created_at", "x"), ("t", "event_date", "x"), ("u", "id", "x")] + [("w", f"c{i}", "x") for i in range(21)],
        "table_name string, column_name string, data_type string",
    )
    assert rows(partition_advice(c)) == [("t", "date", "event_date"), ("u", "none", None), ("w", "none", None)]
    assert rows(join_advice(c)) == [
        ("t", "broadcast", True, 200, "low"), ("u", "broadcast", True, 200, "medium"), ("w", "sort_merge", False, 400, "low"),
    ]
    assert rows(cost_columns(c).select("table_name", "estimated_scan_gb", "estimated_runtime_minutes", "estimated_cost_usd")) == [
        ("t", 1.0, 5, 1.25), ("u", 0.5, 5, 1.25), ("w", 10.5, 10, 2.5),
    ]
