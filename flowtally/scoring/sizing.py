"""Sizing and tuning advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, best first
PARTITION_COLUMNS = ("event_date", "ingestion_date", "created_at")
SKEWED_COLUMNS = ("id", "customer_id")


def job_sizing(jobs: DataFrame) -> DataFrame:
    """Cluster settings of jobs (data_gb, joins, sla_minutes)."""
    gb = F.col("data_gb")
    return jobs.withColumns(
        {
            "executor_instances": F.greatest(F.lit(2), (gb / 5).cast("int")),
            "executor_cores": F.when(F.col("joins") < 3, 4).otherwise(6),
            "executor_memory": F.when(gb < 50, "8g").otherwise("14g"),
            "shuffle_partitions": F.greatest(F.lit(200), (gb * 4).cast("int")),
            "speculation": F.coalesce(
                (F.col("sla_minutes") != 0) & (F.col("sla_minutes") < 30), F.lit(False)
            ),
        }
    )


def tuning_hints(jobs: DataFrame) -> DataFrame:
    """Add ``hints`` to jobs (shuffle_stages, executor_memory_gb)."""
    shuffles, memory = F.col("shuffle_stages") > 2, F.col("executor_memory_gb") < 8
    return jobs.withColumn(
        "hints",
        F.array_compact(
            F.array(
                F.when(shuffles, "Increase shuffle partitions"),
                F.when(shuffles, "Enable Adaptive Query Execution"),
                F.when(memory, "Increase executor memory to at least 8GB"),
            )
        ),
    )


def partition_advice(columns: DataFrame) -> DataFrame:
    """Partition column per table of a column catalog: the best known name that occurs."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(PARTITION_COLUMNS):
        rank = F.when(F.col("column_name") == name, F.lit(i)).otherwise(rank)
    best = columns.groupBy("table_name").agg(F.min(rank).alias("__r"))
    return best.select(
        "table_name",
        F.when(F.col("__r").isNull(), "none").otherwise("date").alias("strategy"),
        F.get(F.array(*[F.lit(c) for c in PARTITION_COLUMNS]), F.col("__r")).alias("partition_column"),
    )


def join_advice(columns: DataFrame) -> DataFrame:
    """Join strategy, shuffle partitions and skew risk per table of a column catalog."""
    n = F.col("column_count")
    counted = columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.coalesce(F.bool_or(F.col("column_name").isin(*SKEWED_COLUMNS)), F.lit(False)).alias("__skew"),
    )
    return counted.select(
        "table_name",
        F.when(n < 10, "broadcast").otherwise("sort_merge").alias("join_strategy"),
        (n < 10).alias("broadcast_recommended"),
        F.when(n > 20, 400).otherwise(200).alias("shuffle_partitions"),
        F.when(F.col("__skew"), "medium").otherwise("low").alias("skew_risk"),
    )
