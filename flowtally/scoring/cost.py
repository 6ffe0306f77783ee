"""Cost and runtime estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.operators.lookups import with_price

SPOT_DISCOUNT = 0.60
INFRA_SHARE = 0.08


def cost_cloud(jobs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Cloud cost of jobs (provider, region, instance_type, executors, vcpu_per_executor, spot, runtime_minutes)."""
    priced = with_price(jobs, overrides)
    price = F.col("vcpu_hour_usd") * F.when(F.col("spot"), F.lit(1.0 - SPOT_DISCOUNT)).otherwise(F.lit(1.0))
    hours = F.greatest(F.col("runtime_minutes"), F.lit(1.0)) / 60.0
    vcpus = F.greatest(F.col("executors"), F.lit(1)) * F.greatest(F.col("vcpu_per_executor"), F.lit(0.5))
    confidence = (
        F.lit(0.80)
        - F.when(F.col("region").isNull(), F.lit(0.05)).otherwise(F.lit(0.0))
        - F.when(F.col("instance_type").isNull(), F.lit(0.05)).otherwise(F.lit(0.0))
    )
    raw = priced.withColumns({"price_per_vcpu_hour": price, "__c": vcpus * price * hours})
    return raw.withColumns(
        {
            "compute_cost_usd": F.round("__c", 4),
            "infra_cost_usd": F.round(F.col("__c") * INFRA_SHARE, 4),
            "estimated_total_cost_usd": F.round(F.col("__c") + F.col("__c") * INFRA_SHARE, 4),
            "cost_confidence": F.round(confidence, 3),
        }
    ).drop("__c", "vcpu_hour_usd", "region_used")


def cost_preflight(jobs: DataFrame) -> DataFrame:
    """Estimate from jobs (estimated_input_gb, shuffle_multiplier, executors, cost_per_executor_hour)."""
    gb, executors = F.col("estimated_input_gb"), F.col("executors")
    minutes = F.greatest(
        F.lit(1.0), gb * F.col("shuffle_multiplier") / F.greatest(F.lit(0.5), executors.cast("double")) * 5.0
    )
    raw = jobs.withColumn("__m", minutes)
    cost = F.col("__m") / 60.0 * executors * F.col("cost_per_executor_hour")
    return raw.withColumns(
        {
            "runtime_minutes": F.round("__m", 2),
            "compute_cost_usd": F.round(cost, 2),
            "confidence": F.when(gb > 100, 0.6).when(gb < 10, 0.85).otherwise(0.7),
        }
    ).drop("__m")


def cost_cluster(jobs: DataFrame) -> DataFrame:
    """Estimate from jobs (num_stages, shuffle_stages, base_parallelism, executor_instances, instance_hourly_rate)."""
    base = F.col("num_stages") * 2.5 + F.col("shuffle_stages") * 3.0
    minutes = F.round(base / F.greatest(F.lit(1.0), F.col("base_parallelism") / 200.0), 2)
    raw = jobs.withColumn("runtime_minutes", minutes)
    cost = F.col("runtime_minutes") / 60.0 * F.col("executor_instances") * F.col("instance_hourly_rate")
    return raw.withColumn("cost_estimate_usd", F.round(cost, 2))


def cost_columns(columns: DataFrame) -> DataFrame:
    """Estimate per table from its column count; ``columns`` is a column catalog."""
    n = F.col("column_count")
    minutes = F.greatest(F.lit(5).cast("bigint"), F.floor(n / 2))
    counted = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))
    return counted.withColumn("estimated_runtime_minutes", minutes).withColumns(
        {
            "estimated_scan_gb": n * F.lit(0.5),
            "estimated_cost_usd": F.round(F.col("estimated_runtime_minutes") * F.lit(0.25), 2),
        }
    )
