"""Table loads per micro-batch.

Each batch writes its own ``batch_id=N`` folder and replaces only that, so a
batch that runs twice changes nothing.  A batch costs what it changes: tables
are merged when they are read, not rewritten per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.operators.admission import budget_admission
from flowtally.operators.ordered import latest_per_key
from flowtally.plans.cdc import latest_changes
from flowtally.plans.late import late_arrival_scd2

BatchWriter = Callable[[DataFrame, int], None]


def _write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/batch_id={batch_id}")


def _read_batches(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    try:
        df = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return df if before is None else df.where(F.col("batch_id") < before)


def stream_cdc_apply(root: str, keys: Sequence[str], order: Sequence[str]) -> BatchWriter:
    """``foreachBatch`` writer that stores the last change per key of each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(latest_changes(batch, keys, order), f"{root}/changes", batch_id)

    return write


def read_cdc_table(
    spark: SparkSession,
    root: str,
    base: DataFrame,
    keys: Sequence[str],
    op_col: str = "op",
) -> DataFrame:
    """The base table with all stored batches applied; the last batch of a key wins."""
    changes = _read_batches(spark, f"{root}/changes")
    if changes is None:
        return base
    # changes without a key belong to no key and all count
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    last = latest_per_key(changes.where(known), keys, ["batch_id"]).unionByName(changes.where(~known))
    kept = base.join(last.select(*keys), list(keys), "left_anti").select(*base.columns)
    return kept.unionByName(last.where(F.coalesce(F.col(op_col) != "D", F.lit(True))).select(*base.columns))


def stream_incremental_dedup(
    source: DataFrame,
    watermark_col: str,
    keys: Sequence[str],
    delay: str = "1 hour",
    deduplicate: bool = True,
) -> DataFrame:
    """Rows of an incremental source, without copies that come within ``delay``.

    State is dropped as the watermark moves on.
    """
    timed = source.withColumn(watermark_col, F.col(watermark_col).cast("timestamp")).withWatermark(watermark_col, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys)) if deduplicate else timed


def stream_late_scd2(
    root: str,
    keys: Sequence[str],
    effective_from: str = "effective_dt",
    tie_break: Sequence[str] = (),
) -> BatchWriter:
    """``foreachBatch`` writer of dimension versions, late ones included.

    A batch stores its rows, then rebuilds the validity of the keys it
    touches; other keys are not read past the semi join.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _write_batch(batch, f"{root}/rows", batch_id)
        rows = _read_batches(spark, f"{root}/rows", batch_id + 1)
        touched = spark.read.parquet(f"{root}/rows/batch_id={batch_id}").select(*keys).distinct()
        history = rows.join(touched, list(keys), "left_semi").drop("batch_id")
        rebuilt = late_arrival_scd2(history, keys, effective_from, tie_break=tie_break)
        _write_batch(rebuilt, f"{root}/versions", batch_id)

    return write


def read_scd2_history(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """All versions as of the last batch that touched each key."""
    versions = _read_batches(spark, f"{root}/versions")
    if versions is None:
        raise ValueError(f"no batch stored below {root}")
    last = versions.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return versions.join(last, [*keys, "batch_id"], "left_semi").drop("batch_id")


def stream_budget_admission(
    root: str,
    budgets: DataFrame,
    order: str = "seq",
    blocked: str | None = None,
    default_limit: float | None = None,
) -> BatchWriter:
    """``foreachBatch`` writer that decides requests against what earlier batches admitted."""

    def write(batch: DataFrame, batch_id: int) -> None:
        before = _read_batches(batch.sparkSession, f"{root}/decisions", batch_id)
        ledger = None
        if before is not None:
            groups = batch.select("tenant", "month").distinct()
            kept = before.where(F.col("decision").isin("ALLOW", "WARN") & F.col("estimated_cost_usd").isNotNull())
            kept = kept.join(groups, ["tenant", "month"], "left_semi")
            ledger = kept.groupBy("tenant", "month", "entry_id").agg(
                F.max_by("estimated_cost_usd", F.struct("batch_id", order)).alias("estimated_cost_usd")
            )
        decided = budget_admission(batch, budgets, ledger, order, blocked, default_limit)
        _write_batch(decided, f"{root}/decisions", batch_id)

    return write
