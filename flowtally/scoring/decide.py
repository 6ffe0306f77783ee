"""Policy decisions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.scalars import filled
from flowtally.operators.aggregates import spend_estimated
from flowtally.operators.lookups import with_budget
from flowtally.scoring.risk import sla_breach

MODES = ("strict", "balanced", "permissive")


@dataclass(frozen=True)
class ExecutionLimits:
    max_total_cost_usd: float = 50.0
    max_runtime_minutes: float = 180.0
    max_executors: int = 200
    monthly_budget_warn_ratio: float = 0.80
    high_risk: float = 0.70


def decide_preflight(jobs: DataFrame) -> DataFrame:
    """Add ``decision`` to the output of ``risk_preflight``."""
    decision = (
        F.when(F.col("risk_score") > 0.85, "BLOCK")
        .when((F.col("compute_cost_usd") > 300) | sla_breach(), "WARN")
        .otherwise("ALLOW")
    )
    return jobs.withColumn("decision", decision)


def _violations(limits: Mapping[str, float]) -> tuple[list[Column], Column]:
    """Texts of the hard violations, and of the low confidence."""

    def over(column: str, limit: str) -> Column:
        value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        text = F.concat(F.lit(f"{column} "), F.col(column).cast("string"), F.lit(f" exceeds {limit} {limits[limit]}"))
        return F.when(value > float(limits[limit]), text)

    hard = [
        over("cost_estimate_usd", "max_cost_usd"),
        over("risk_score", "max_risk_score"),
        over("failure_probability", "max_failure_probability"),
    ]
    low = limits["min_confidence_score"]
    sure = F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0))
    text = F.concat(F.lit("confidence_score "), sure.cast("string"), F.lit(f" below min_confidence_score {low}"))
    return hard, F.when(sure < float(low), text)


def threshold_violations(jobs: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Add ``reasons`` of jobs (cost_estimate_usd, risk_score, failure_probability, confidence_score).

    ``limits`` has max_cost_usd, max_risk_score, max_failure_probability and
    min_confidence_score.
    """
    hard, soft = _violations(limits)
    return jobs.withColumn("reasons", F.array_compact(F.array(*hard, soft)))


def decide_thresholds(jobs: DataFrame, limits: Mapping[str, float], mode: str = "balanced") -> DataFrame:
    """Add ``reasons`` and ``decision``.

    strict blocks on any reason; balanced blocks on cost, risk or failure and
    warns on confidence alone; permissive warns, and blocks on extreme risk.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    out = threshold_violations(jobs, limits)
    hard, _ = _violations(limits)
    any_hard = F.lit(False)
    for text in hard:
        any_hard = any_hard | text.isNotNull()
    any_reason = F.size("reasons") > 0
    if mode == "strict":
        decision = F.when(any_reason, "BLOCK")
    elif mode == "balanced":
        decision = F.when(any_hard, "BLOCK").when(any_reason, "WARN")
    else:
        extreme = (F.col("risk_score") >= 90) | (F.col("failure_probability") >= 0.6)
        decision = F.when(extreme, "BLOCK").when(any_reason, "WARN")
    return out.withColumn("decision", F.coalesce(decision, F.lit("ALLOW")))


def _note(when: Column, kind: str, code: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), message.alias("message")))


def guardrail_reasons(limits: ExecutionLimits) -> list[Column]:
    """Reasons that depend on the job alone: cost, runtime, executors."""
    cost, minutes, executors = F.col("estimated_total_cost_usd"), F.col("runtime_minutes"), F.col("executors")
    return [
        _note(
            cost > limits.max_total_cost_usd,
            "cost",
            "exec.cost.too_high",
            F.format_string(
                f"Estimated total cost $%.2f exceeds tenant max ${limits.max_total_cost_usd:.2f}.", cost.cast("double")
            ),
        ),
        _note(
            minutes > limits.max_runtime_minutes,
            "runtime",
            "exec.runtime.too_high",
            F.format_string(
                f"Estimated runtime %.1fm exceeds tenant max {limits.max_runtime_minutes:.1f}m.", minutes.cast("double")
            ),
        ),
        _note(
            executors > limits.max_executors,
            "resources",
            "exec.executors.too_high",
            F.format_string(f"Executors %d exceeds tenant max {limits.max_executors}.", executors.cast("bigint")),
        ),
    ]


def decide_execution(
    jobs: DataFrame,
    ledger: DataFrame,
    budgets: DataFrame,
    limits: ExecutionLimits = ExecutionLimits(),
    default_limit: float | None = None,
) -> DataFrame:
    """Add ``reasons``, ``warnings`` and ``decision`` to jobs.

    Jobs are (tenant, month, estimated_total_cost_usd, runtime_minutes,
    executors, risk_score).  The ledger is summed per tenant and month before
    it meets the jobs.
    """
    spent = spend_estimated(ledger)
    out = with_budget(jobs.join(spent, ["tenant", "month"], "left"), budgets, default_limit)
    out = out.withColumnRenamed("spent_estimated_usd", "spent_usd").fillna({"spent_usd": 0.0})
    limit, used = F.col("limit_usd"), F.col("spent_usd")
    new = F.coalesce(F.col("estimated_total_cost_usd"), F.lit(0.0))
    projected = used + new
    share = F.when(limit > 0, F.try_divide(projected, limit))
    gone, above = used >= limit, (used < limit) & (projected > limit)
    budget = [
        _note(
            gone,
            "budget",
            "exec.budget.exceeded",
            F.format_string("Monthly budget exhausted for %s: spent=$%.2f >= limit=$%.2f.", "month", used, limit),
        ),
        _note(
            above,
            "budget",
            "exec.budget.exceeded",
            F.format_string(
                "Monthly budget exceeded for %s: spent=$%.2f + new=$%.2f > limit=$%.2f.", "month", used, new, limit
            ),
        ),
    ]
    warnings = [
        _note(
            ~gone & ~above & (share >= limits.monthly_budget_warn_ratio),
            "budget",
            "exec.budget.near_limit",
            F.format_string(
                "Monthly budget near limit for %s: projected=$%.2f (%.0f%%) of limit=$%.2f.",
                "month",
                projected,
                share * 100,
                limit,
            ),
        ),
        _note(
            F.col("risk_score") >= limits.high_risk,
            "risk",
            "exec.risk.high",
            F.format_string(
                "High risk score %.2f (execution allowed, but risky).", F.col("risk_score").cast("double")
            ),
        ),
    ]
    out = out.withColumns(
        {
            "reasons": F.array_compact(F.array(*guardrail_reasons(limits), *budget)),
            "warnings": F.array_compact(F.array(*warnings)),
        }
    )
    decision = F.when(F.size("reasons") > 0, "BLOCK").when(F.size("warnings") > 0, "WARN").otherwise("ALLOW")
    return out.withColumn("decision", decision)


def approval_required(jobs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Add ``required`` and ``approval_reason`` by ``risk_score``."""
    score = F.col("risk_score").cast("double")
    high = score >= float(threshold)
    return jobs.withColumns(
        {
            "required": F.coalesce(high, F.lit(False)),
            "approval_reason": F.when(score.isNull(), "risk_score_missing")
            .when(high, "high_risk_requires_approval")
            .otherwise("risk_below_threshold"),
        }
    )


def spec_policy(specs: DataFrame) -> DataFrame:
    """Policy results of specs (job_name, owner, source_table, target_table), one row per finding."""

    def result(when: Column, status: str, code: str) -> Column:
        return F.when(when, F.struct(F.lit(status).alias("status"), F.lit(code).alias("code")))

    def bad(name: str) -> Column:
        return ~F.coalesce(F.col(name).contains("."), F.lit(False))

    results = F.array(
        result(filled("owner").isNull(), "WARN", "OWNER_MISSING"),
        F.coalesce(
            result(bad("source_table"), "FAIL", "SOURCE_TABLE_INVALID"),
            result(bad("target_table"), "FAIL", "TARGET_TABLE_INVALID"),
        ),
    )
    return specs.select("job_name", F.explode(F.array_compact(results)).alias("__r")).select("job_name", "__r.*")
