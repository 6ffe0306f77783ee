"""Spend, counters and roll-ups; all of them combine rows in each task first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.scalars import filled
from flowtally.operators.lookups import with_budget

BUDGET_WARN_RATIO = 0.80
AI_PREFIX = "ai_"
SEVERITIES = ("info", "warn", "block")


def _sum(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def spend_estimated(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("tenant", "month").agg(_sum("estimated_cost_usd").alias("spent_estimated_usd"))


def spend_actual(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("tenant", "month").agg(_sum("actual_cost_usd").alias("spent_actual_usd"))


def _is_ai(prefix: str) -> Column:
    return F.coalesce(F.col("job_name").startswith(prefix), F.lit(False))


def spend_breakdown(ledger: DataFrame, prefix: str = AI_PREFIX) -> DataFrame:
    """Actual spend of AI jobs, of the others, and of both."""
    ai = _is_ai(prefix)
    cost = F.col("actual_cost_usd")
    split = ledger.groupBy("tenant", "month").agg(
        _sum(F.when(ai, cost)).alias("ai_actual_usd"),
        _sum(F.when(~ai, cost)).alias("non_ai_actual_usd"),
    )
    return split.withColumn("total_actual_usd", F.col("ai_actual_usd") + F.col("non_ai_actual_usd"))


def spend_by_ai_task(ledger: DataFrame, prefix: str = AI_PREFIX) -> DataFrame:
    """Actual spend per AI job name, to 6 decimals, as rows."""
    rows = ledger.where(_is_ai(prefix) & F.col("actual_cost_usd").isNotNull())
    return rows.groupBy("tenant", "month", "job_name").agg(F.round(F.sum("actual_cost_usd"), 6).alias("ai_task_usd"))


def entries_count(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("tenant", "month").agg(F.count(F.lit(1)).alias("entries_count"))


def billing_summary(
    ledger: DataFrame,
    budgets: DataFrame,
    default_limit: float | None = None,
    prefix: str = AI_PREFIX,
) -> DataFrame:
    """Spend, budget use and budget status per tenant and month, in one pass over the ledger."""
    ai = _is_ai(prefix)
    actual = F.col("actual_cost_usd")
    spent = ledger.groupBy("tenant", "month").agg(
        _sum("estimated_cost_usd").alias("spent_estimated_usd"),
        _sum(actual).alias("spent_actual_usd"),
        _sum(F.when(ai, actual)).alias("ai_spent_actual_usd"),
        _sum(F.when(~ai, actual)).alias("non_ai_spent_actual_usd"),
        F.count(F.lit(1)).alias("entries_count"),
    )
    limit, est = F.col("limit_usd"), F.col("spent_estimated_usd")
    use = F.when(limit <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(est, limit)))
    status = (
        F.when((limit > 0) & (est >= limit), "exceeded").when(use >= BUDGET_WARN_RATIO, "warning").otherwise("ok")
    )
    return with_budget(spent, budgets, default_limit).withColumns(
        {
            "remaining_estimated_usd": F.greatest(F.lit(0.0), limit - est),
            "utilization_estimated": use,
            "projected_spent_usd": est,
            "projected_utilization": use,
            "budget_status": status,
        }
    )


def request_counters(df: DataFrame, method: str = "method", path: str = "path", status: str = "status") -> DataFrame:
    """Request counts: total, per method, per path, per path and status, and per all three.

    ``counter`` names the level; columns a level does not use are NULL.  Rows
    are counted once at the finest level, and only those counts are rolled up.
    """
    fine = df.groupBy(
        F.upper(F.coalesce(filled(method), F.lit("UNKNOWN"))).alias("method"),
        F.coalesce(filled(path), F.lit("/")).alias("path"),
        F.coalesce(F.col(status).cast("string"), F.lit("unknown")).alias("status"),
    ).agg(F.count(F.lit(1)).alias("n"))
    m, p, s = F.col("method"), F.col("path"), F.col("status")
    level = F.grouping_id()
    counter = (
        F.when(level == 7, "total")
        .when(level == 3, "method")
        .when(level == 5, "path")
        .when(level == 4, "path_status")
        .otherwise("method_path_status")
    )
    sets = [[], [m], [p], [p, s], [m, p, s]]
    return fine.groupingSets(sets, m, p, s).agg(counter.alias("counter"), F.sum("n").alias("requests"))


def named_counters(df: DataFrame, name: str = "name", value: str | None = None) -> DataFrame:
    """Sum of increments per name; rows without a name are left out."""
    step = F.col(value).cast("bigint") if value else F.lit(1)
    return df.where(filled(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.sum(step).alias("total"))


def max_severity(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst severity, and FAIL if it is ``block``."""
    rank = F.when(F.col("severity") == "block", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    worst = findings.groupBy(*keys).agg(F.coalesce(F.max(rank), F.lit(0)).alias("__r"))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return worst.select(
        *keys,
        F.get(names, F.col("__r")).alias("max_severity"),
        F.when(F.col("__r") == 2, "FAIL").otherwise("PASS").alias("status"),
    )


def is_blocking(results: DataFrame, keys: Sequence[str] = ("job_name",)) -> DataFrame:
    """Whether any policy result of a job is FAIL."""
    return results.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("status") == "FAIL"), F.lit(False)).alias("blocking")
    )


def histogram_counts(
    df: DataFrame,
    value: str,
    buckets: Sequence[float],
    keys: Sequence[str] = ("method", "path"),
) -> DataFrame:
    """Cumulative bucket counts, ``le_inf``, sum and count per key, in one pass."""
    bounds = [
        F.count_if(F.col(value) <= float(b)).alias("le_" + f"{float(b):g}".replace(".", "_")) for b in sorted(buckets)
    ]
    seen = F.count(F.col(value))
    return df.groupBy(*keys).agg(
        *bounds, seen.alias("le_inf"), _sum(value).alias("value_sum"), seen.alias("value_count")
    )


def finding_counts(findings: DataFrame, key: str = "plan_id") -> DataFrame:
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("finding_count"))
