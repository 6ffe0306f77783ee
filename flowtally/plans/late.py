"""Late rows in versioned history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.plans.scd import OPEN_END
from flowtally.skew import CHUNK_ROWS, with_next


def late_arrival_scd2(
    history: DataFrame,
    keys: Sequence[str],
    effective_from: str = "effective_dt",
    effective_to: str = "end_dt",
    current_flag: str = "is_current",
    tie_break: Sequence[str] = (),
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rebuild validity: each version ends where the next one of its key starts.

    A late row thereby closes its predecessor and reopens up to its successor.
    ``tie_break`` orders versions that start at the same time.
    """
    base = history.drop(effective_to, current_flag)
    out = with_next(
        base, keys, [effective_from, *tie_break], {"__until": effective_from}, chunk_rows=chunk_rows
    )
    return out.select(
        *base.columns,
        F.coalesce(F.col("__until").cast("timestamp"), F.lit(OPEN_END).cast("timestamp")).alias(effective_to),
        F.col("__until").isNull().alias(current_flag),
    )
