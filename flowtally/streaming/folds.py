"""Stateful folds: rate limit, stale runs, cancel and retry.

State per key is a handful of numbers, and keys leave the state: a rate limit
key when its window is over, a run when it ends or, where rows have a time, has
ended long ago.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowtally.operators.lifecycle import ACTIVE, RETRYABLE, STALE_CANCEL, STALE_RUN, TERMINAL
from flowtally.operators.ratelimit import COUNTED_METHODS, RPM

_MICRO = 1_000_000


def stream_rate_limit(
    events: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    rpm: int = RPM,
    method: str | None = None,
    window_seconds: float = 60,
    delay: str = "10 minutes",
) -> DataFrame:
    """(key, event_id, ts, window_start, window_count, over_limit), in append mode.

    Requests of a key are taken in time order within a micro-batch.  Once event
    time, held back by ``delay``, has passed the end of a key's window, the key
    leaves the state: whatever may still come opens a new window.  Requests
    that come later than ``delay`` are left out, as in any watermarked stream.
    """
    if method:
        events = events.where(F.upper(F.col(method)).isin(*COUNTED_METHODS))
    window, allowed = int(window_seconds * _MICRO), max(1, int(rpm))
    kind = events.schema[event_id].dataType.simpleString()
    slim = events.select(
        F.col(key).cast("string").alias("key"),
        F.col(event_id).alias("event_id"),
        F.col(ts).cast("timestamp").alias("ts"),
    ).where("ts is not null")
    slim = slim.withWatermark("ts", delay).withColumn("t", F.unix_micros("ts"))

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        starts, counts = [], []
        for t in rows["t"].tolist():
            if start is None or t - start >= window:
                start, count = t, 0
            count += 1
            starts.append(start)
            counts.append(count)
        state.update((start, count))
        over = -(-(start + window) // 1000)
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "key": [keys[0]] * len(rows),
                "event_id": rows["event_id"].to_numpy(),
                "t": rows["t"].to_numpy(),
                "start": starts,
                "window_count": counts,
            }
        )

    folded = slim.groupBy("key").applyInPandasWithState(
        fold,
        f"key string, event_id {kind}, t bigint, start bigint, window_count bigint",
        "start bigint, count bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return folded.select(
        "key",
        "event_id",
        F.timestamp_micros("t").alias("ts"),
        F.timestamp_micros("start").alias("window_start"),
        "window_count",
        (F.col("window_count") > allowed).alias("over_limit"),
    )


def stream_stale_runs(heartbeats: DataFrame, stale_after_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """Runs whose last heartbeat (run_id, status, updated_ts, cancel_requested) is too old.

    A run is reported once event time has passed its last update by more than
    the limit: CANCELED if it was asked to cancel, else FAILED.
    """
    limit_ms = int(stale_after_seconds * 1000)
    timed = heartbeats.withColumn("ts", F.col("updated_ts").cast("timestamp")).withWatermark("ts", delay)
    slim = timed.select("run_id", "status", F.coalesce("cancel_requested", F.lit(False)).alias("asked"), "ts").withColumn(
        "ms", F.unix_millis("ts")
    )
    schema = "run_id string, status string, terminal_reason string, last_update timestamp"

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ms, asked = state.get
            state.remove()
            yield pd.DataFrame(
                {
                    "run_id": [keys[0]],
                    "status": ["CANCELED" if asked else "FAILED"],
                    "terminal_reason": [STALE_CANCEL if asked else STALE_RUN],
                    "last_update": [pd.Timestamp(ms, unit="ms")],
                }
            )
            return
        last = state.get if state.exists else None
        status = None
        for batch in batches:
            if len(batch):
                row = batch.sort_values("ms", kind="stable").iloc[-1]
                if last is None or row["ms"] >= last[0]:
                    last, status = (int(row["ms"]), bool(row["asked"])), row["status"]
        if status in TERMINAL:
            if state.exists:
                state.remove()
            return
        if last is not None:
            state.update(last)
            due = last[0] + limit_ms
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return slim.groupBy("run_id").applyInPandasWithState(
        fold, schema, "ms bigint, asked boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_request_commands(
    commands: DataFrame, ts: str | None = None, delay: str = "1 hour", forget_after_seconds: float = 7 * 86_400
) -> DataFrame:
    """State of a run after each micro-batch, in update mode.

    Rows are (run_id, command, status, seq): ``report`` sets the status, and
    ``cancel`` and ``retry`` act on it as ``apply_commands`` does.  A command
    for a run that was never reported is an error.

    With ``ts``, the time column of the rows, runs leave the state: one that
    has ended, or of which only errors are known, goes once event time, held
    back by ``delay``, has passed its last row by ``forget_after_seconds``, and
    counts as never reported from then on.  Active runs stay.  Rows later than
    ``delay`` are left out.  Without ``ts`` there is no clock and all runs stay.
    """
    forget_ms = int(forget_after_seconds * 1000)
    slim = [F.col("run_id"), F.col("command"), F.col("status"), F.col("seq").cast("bigint").alias("seq")]
    timed = commands.select(*slim)
    if ts:
        clock = commands.select(*slim, F.col(ts).cast("timestamp").alias("ts"))
        timed = clock.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    schema = "run_id string, status string, cancel_requested boolean, retry_count bigint, errors bigint"

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, asked, retries, errors = state.get if state.exists else (None, False, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for command, told in zip(rows["command"], rows["status"], strict=True):
            if command == "report":
                status = told
            elif status is None:
                errors += 1
            elif command == "cancel" and status not in TERMINAL:
                status, asked = "CANCELING", True
            elif command == "retry" and status in RETRYABLE:
                status, asked, retries = "PENDING", False, retries + 1
            elif command == "retry" and status not in ACTIVE:
                errors += 1
        state.update((status, asked, retries, errors))
        # an update clears the timer, so an active run has none
        if ts and (status is None or status in TERMINAL):
            last = rows["ms"].max()
            due = state.getCurrentWatermarkMs() if pd.isna(last) else int(last)
            state.setTimeoutTimestamp(max(due + forget_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "run_id": [keys[0]],
                "status": [status],
                "cancel_requested": [asked],
                "retry_count": [retries],
                "errors": [errors],
            }
        )

    return timed.groupBy("run_id").applyInPandasWithState(
        fold,
        schema,
        "status string, asked boolean, retries bigint, errors bigint",
        "update",
        GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout,
    )
