"""Operators that need the order of a log: last write, patches, transitions, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.skew import CHUNK_ROWS, with_position, with_previous

# Fixed values
ALLOWED_TRANSITIONS = (
    ("DRAFT", "PLAN_READY"),
    ("PLAN_READY", "PRECHECK_PASSED"),
    ("PRECHECK_PASSED", "APPLIED"),
    ("APPLIED", "RUNNING"),
    ("APPLIED", "CANCELED"),
    ("RUNNING", "CANCELED"),
    ("RUNNING", "SUCCEEDED"),
    ("RUNNING", "FAILED"),
    ("PRECHECK_PASSED", "BLOCKED"),
    ("PLAN_READY", "BLOCKED"),
    ("DRAFT", "BLOCKED"),
)
TERMINAL_STATES = ("SUCCEEDED", "FAILED", "BLOCKED", "CANCELED")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows (at least 1) of each key; ``order`` must be total.

    Each task keeps its own first ``k`` rows per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(1, int(k))).drop("__n")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last write of each key replaces the earlier ones."""
    return top_k_per_group(df, keys, [F.col(c).desc_nulls_last() for c in order], 1)


PATCHED = ("actual_cost_usd", "actual_runtime_seconds", "finished_ts")


def coalesce_patches(
    estimates: DataFrame,
    actuals: DataFrame,
    order: str = "seq",
    fields: Sequence[str] = PATCHED,
    key: str = "entry_id",
) -> DataFrame:
    """Ledger rows from the estimate log and the log of actuals.

    The last estimate of an entry counts.  An actual overwrites only with
    fields that are set, and an estimate written after it clears them, because
    it replaces the entry.  Actuals without an estimate make an entry with
    estimate 0.  ``order`` is one sequence over both logs.  Rows of a key are
    reduced by ``max_by`` in each task, so repeated patches do not travel.
    """
    shared = [c for c in estimates.columns if c not in (key, order, *fields)]
    both = estimates.select(
        key, order, *shared, *[F.lit(None).cast(actuals.schema[f].dataType).alias(f) for f in fields],
        F.lit(True).alias("__est"),
    ).unionByName(
        actuals.select(
            key,
            order,
            *[
                F.col(c) if c in actuals.columns else F.lit(None).cast(estimates.schema[c].dataType).alias(c)
                for c in shared
            ],
            *fields,
            F.lit(False).alias("__est"),
        )
    )
    is_est = F.col("__est")
    packed = F.struct(*shared)
    folded = both.groupBy(key).agg(
        F.max(F.when(is_est, F.col(order))).alias("__last"),
        F.max_by(packed, F.when(is_est, F.col(order))).alias("__e"),
        F.min_by(packed, F.when(~is_est, F.col(order))).alias("__first"),
        *[
            F.max_by(F.struct(F.col(f).alias("v"), F.col(order).alias("o")), F.when(~is_est & F.col(f).isNotNull(), F.col(order))).alias(f"__{f}")
            for f in fields
        ],
    )
    base = F.coalesce(F.col("__e"), F.col("__first"))
    out = []
    for c in shared:
        value = base[c]
        if c == "estimated_cost_usd":
            value = F.when(F.col("__e").isNotNull(), value).otherwise(F.lit(0.0))
        out.append(value.alias(c))
    for f in fields:
        newer = F.col("__last").isNull() | (F.col(f"__{f}.o") > F.col("__last"))
        out.append(F.when(newer, F.col(f"__{f}.v")).alias(f))
    return folded.select(key, *out)


def current_build(builds: DataFrame, key: str = "job_name", order: Sequence[str] = ("seq",)) -> DataFrame:
    """The newest build of each job."""
    return latest_per_key(builds, [key], order)


def needs_rebuild(
    requests: DataFrame,
    key: str = "job_name",
    order: Sequence[str] = ("seq",),
    hash_col: str = "spec_hash",
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``rebuild``: the specification differs from the job's previous one."""
    marked = requests.withColumn("__seen", F.lit(True))
    out = with_previous(
        marked, [key], order, {"previous_hash": hash_col, "__had": "__seen"}, chunk_rows=chunk_rows
    )
    changed = F.col("__had").isNull() | ~F.col(hash_col).eqNullSafe(F.col("previous_hash"))
    return out.withColumn("rebuild", changed).select(*requests.columns, "previous_hash", "rebuild")


def transition_legal(previous: Column | str, state: Column | str) -> Column:
    """Equal states, or an allowed pair that does not leave a terminal state."""
    a = F.col(previous) if isinstance(previous, str) else previous
    b = F.col(state) if isinstance(state, str) else state
    pair = F.concat(a, F.lit(">"), b)
    return (a == b) | (~a.isin(*TERMINAL_STATES) & pair.isin(*[f"{x}>{y}" for x, y in ALLOWED_TRANSITIONS]))


def check_transitions(
    events: DataFrame,
    key: str = "job_name",
    order: Sequence[str] = ("ts", "seq"),
    state: str = "state",
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``previous_state`` and ``legal``; the first event of a key is legal."""
    out = with_previous(events, [key], order, {"previous_state": state}, chunk_rows=chunk_rows)
    legal = F.coalesce(transition_legal("previous_state", state), F.lit(True))
    return out.withColumn("legal", legal)


def execution_actuals(records: DataFrame) -> DataFrame:
    """Runtime and cost of finished executions, with the month they finished in.

    Runtime is finished minus submitted, at least 0; the cost is the estimate.
    """
    micros = F.unix_micros(F.col("finished_ts").cast("timestamp")) - F.unix_micros(
        F.col("submitted_ts").cast("timestamp")
    )
    seconds = F.when(micros.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(1e6)))
    return records.where(F.col("finished_ts").isNotNull()).withColumns(
        {
            "month": F.date_format("finished_ts", "yyyy-MM"),
            "actual_runtime_seconds": seconds,
            "actual_cost_usd": F.col("estimated_cost_usd"),
        }
    )


def execution_history(
    events: DataFrame,
    key: str = "job_name",
    order: Sequence[str] = ("ts", "seq"),
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Events with their place in the job's history; a list per job could grow without limit."""
    return with_position(events, [key], order, "position", chunk_rows=chunk_rows)


def newest_first(df: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order])


def tail_events(
    df: DataFrame,
    limit: int = 200,
    order: Sequence[str] = ("seq",),
    keep: Column | None = None,
) -> DataFrame:
    """The last ``limit`` (1..2000) rows, oldest first.  ``keep`` drops malformed rows after the cut."""
    n = max(1, min(int(limit), 2000))
    out = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    if keep is not None:
        out = out.where(keep)
    return out.orderBy(*[F.col(c).asc() for c in order])


def latest_files(files: DataFrame, limit: int = 50) -> DataFrame:
    """Newest files first, at most 1..200; ties by name."""
    n = max(1, min(int(limit), 200))
    return files.orderBy(F.col("modified_at").desc(), F.col("file_name").asc()).limit(n)
