"""Risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sla_breach() -> Column:
    """Runtime above a limit that is set and not 0."""
    limit = F.col("max_runtime_minutes")
    return F.coalesce((limit != 0) & (F.col("runtime_minutes") > limit), F.lit(False))


def _score(rules: list[tuple[Column, float, str]], points_type: str) -> tuple[Column, Column]:
    """Sum of the points of the rules that hold, and their names."""
    points = F.lit(0).cast(points_type)
    for when, value, _ in rules:
        points = points + F.when(when, F.lit(value)).otherwise(F.lit(0)).cast(points_type)
    return points, F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, _, name in rules]))


def risk_preflight(jobs: DataFrame) -> DataFrame:
    """Add ``risk_score`` (0..1) and ``risk_reasons`` to the output of ``cost_preflight``."""
    rules = [
        (F.col("estimated_input_gb") > 200, 0.3, "large_input_dataset"),
        (F.col("shuffle_multiplier") > 3.0, 0.2, "high_shuffle_multiplier"),
        (sla_breach(), 0.4, "sla_runtime_breach_predicted"),
        (F.col("compute_cost_usd") > 500, 0.2, "high_cost_estimate"),
    ]
    score, reasons = _score(rules, "double")
    return jobs.withColumns({"risk_score": F.round(F.least(F.lit(1.0), score), 2), "risk_reasons": reasons})


def risk_plan(jobs: DataFrame) -> DataFrame:
    """Risk of jobs (shuffle_stages, executor_memory_gb, runtime_minutes) in points."""
    rules = [
        (F.col("shuffle_stages") > 2, 25, "High shuffle amplification"),
        (F.col("executor_memory_gb") < 8, 20, "Low executor memory"),
        (F.col("runtime_minutes") > 60, 20, "Long runtime risk"),
    ]
    score, factors = _score(rules, "int")
    s = F.col("risk_score")
    return jobs.withColumns({"risk_score": score, "factors": factors}).withColumns(
        {
            "risk_level": F.when(s < 30, "LOW").when(s < 70, "MEDIUM").otherwise("HIGH"),
            "failure_probability": F.round(F.least(F.lit(0.9), s / 100), 2),
            "confidence_score": F.greatest(F.lit(0.5), F.round(1 - s / 150, 2)),
        }
    )
