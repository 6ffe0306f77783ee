"""Run records: stale runs, cancel and retry commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELED")
ACTIVE = ("PENDING", "RUNNING", "CANCELING")
RETRYABLE = ("FAILED", "CANCELED")
STALE_CANCEL = "stale_cancel_reconciled"
STALE_RUN = "stale_run_reconciled"


def reconcile_stale_runs(runs: DataFrame, as_of: Column | str, stale_after_seconds: float) -> DataFrame:
    """Close runs that were not updated for longer than the limit; the others stay as they are.

    A run that was asked to cancel becomes CANCELED, any other FAILED.
    """
    at = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
    updated = F.unix_micros(F.col("updated_ts").cast("timestamp"))
    cutoff = F.unix_micros(at) - F.lit(int(stale_after_seconds * 1_000_000))
    stale = F.coalesce(~F.col("status").isin(*TERMINAL) & (updated < cutoff), F.lit(False))
    asked = F.coalesce(F.col("cancel_requested"), F.lit(False))
    kind = runs.schema["updated_ts"].dataType
    return runs.withColumns(
        {
            "status": F.when(stale & asked, "CANCELED").when(stale, "FAILED").otherwise(F.col("status")),
            "terminal_reason": F.when(stale & asked, STALE_CANCEL)
            .when(stale, STALE_RUN)
            .otherwise(F.col("terminal_reason")),
            "updated_ts": F.when(stale, at.cast(kind)).otherwise(F.col("updated_ts")),
            "reconciled": stale,
        }
    )


def apply_commands(runs: DataFrame, commands: DataFrame, order: str = "seq") -> DataFrame:
    """Runs after their ``cancel`` and ``retry`` commands (run_id, command, order, ts), and ``errors``.

    The fold over a run's commands has a closed form, so no command list is
    built and each task reduces its own rows:

    * an active run ends up CANCELING if any cancel came, and retries do nothing;
    * a FAILED or CANCELED run ignores cancels until the first retry makes it
      PENDING (one more ``retry_count``); a cancel after that retry makes it
      CANCELING, and further retries meet an active run;
    * a SUCCEEDED run ignores cancels, and each retry is an error.
    """
    at = F.col(order)
    is_cancel, is_retry = F.col("command") == "cancel", F.col("command") == "retry"
    facts = commands.groupBy("run_id").agg(
        F.max(F.when(is_cancel, at)).alias("__last_cancel"),
        F.max_by("ts", F.when(is_cancel, at)).alias("__cancel_ts"),
        F.min(F.when(is_retry, at)).alias("__first_retry"),
        F.min_by("ts", F.when(is_retry, at)).alias("__retry_ts"),
        F.count_if(is_retry).alias("__retries"),
    )
    status = F.col("status")
    active, retryable = status.isin(*ACTIVE), status.isin(*RETRYABLE)
    retried = F.coalesce(retryable & F.col("__first_retry").isNotNull(), F.lit(False))
    canceled = F.coalesce(
        (active & F.col("__last_cancel").isNotNull())
        | (retried & (F.col("__last_cancel") > F.col("__first_retry"))),
        F.lit(False),
    )
    bad = ~active & ~retryable
    joined = runs.join(facts, "run_id", "left").withColumns({"__retried": retried, "__canceled": canceled})
    was_retried, was_canceled = F.col("__retried"), F.col("__canceled")
    return joined.withColumns(
        {
            "errors": F.when(bad, F.coalesce(F.col("__retries"), F.lit(0))).otherwise(F.lit(0)).cast("bigint"),
            "status": F.when(was_canceled, "CANCELING").when(was_retried, "PENDING").otherwise(status),
            "cancel_requested": F.when(was_canceled, True)
            .when(was_retried, False)
            .otherwise(F.col("cancel_requested")),
            "terminal_reason": F.when(~was_retried, F.col("terminal_reason")),
            "retry_count": F.col("retry_count") + F.when(was_retried, 1).otherwise(0),
            "updated_ts": F.when(was_canceled, F.col("__cancel_ts"))
            .when(was_retried, F.col("__retry_ts"))
            .otherwise(F.col("updated_ts")),
        }
    ).select(*runs.columns, "errors")
