"""Checks on rows; all rules of a table share one aggregate pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_checks(
    df: DataFrame,
    not_null: Sequence[str] = (),
    non_negative: Sequence[str] = (),
    null_thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """(rule_type, column_name, violations, row_count, passed), one row per rule.

    The rules are one aggregation without keys: each task sends one row.
    """
    rules: list[tuple[str, str, Column, float | None]] = []
    for c in dict.fromkeys(not_null):
        rules.append(("not_null", c, F.count_if(F.col(c).isNull()), None))
    for c in dict.fromkeys(non_negative):
        rules.append(("non_negative", c, F.count_if(F.col(c) < 0), None))
    for c, limit in (null_thresholds or {}).items():
        rules.append(("null_threshold", c, F.count_if(F.col(c).isNull()), float(limit)))
    if not rules:
        raise ValueError("no rules given")
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[agg.alias(f"__v{i}") for i, (_, _, agg, _) in enumerate(rules)])
    n = F.col("__n")
    out = []
    for i, (kind, c, _, limit) in enumerate(rules):
        bad = F.col(f"__v{i}")
        ok = bad == 0 if limit is None else F.coalesce(F.try_divide(bad, n), F.lit(0.0)) <= limit
        out.append(
            F.struct(
                F.lit(kind).alias("rule_type"),
                F.lit(c).alias("column_name"),
                bad.alias("violations"),
                n.alias("row_count"),
                ok.alias("passed"),
            )
        )
    return one.select(F.explode(F.array(*out)).alias("__r")).select("__r.*")


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return run_checks(df, not_null=columns)


def check_non_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return run_checks(df, non_negative=columns)


def check_null_threshold(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Fails where the share of NULLs is above the threshold; an empty table passes."""
    return run_checks(df, null_thresholds=thresholds)


def check_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def check_freshness(df: DataFrame, ts: str, as_of: datetime | str, minutes: float) -> DataFrame:
    """One row: newest time, age in minutes, and whether it is within the limit; no rows means stale."""
    newest = df.agg(F.max(F.col(ts).cast("timestamp")).alias("newest"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("newest")) / F.lit(60_000_000.0)
    return newest.withColumn("age_minutes", age).withColumn(
        "passed", F.coalesce(F.col("age_minutes") <= float(minutes), F.lit(False))
    )
