"""Watermark loads and backfills."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtally.plans.presets import preset_dedup
from flowtally.plans.spec import IncrementalSpec


def incremental_filter(source: DataFrame, target: DataFrame, watermark_col: str) -> DataFrame:
    """Source rows strictly newer than the target; an empty target takes all.

    The target's maximum is read first, one value, and becomes a literal: the
    filter then reaches the scan of the source and prunes its partitions.
    """
    if not watermark_col:
        raise ValueError("an increment needs a watermark column")
    kind = target.schema[watermark_col].dataType
    highest = F.max(watermark_col)
    # text and microseconds come back exactly, whatever the zone of the driver
    instant = isinstance(kind, T.TimestampType)
    high = target.agg(F.unix_micros(highest) if instant else highest.cast("string")).first()[0]
    if high is None:
        return source
    return source.where(F.col(watermark_col) > (F.timestamp_micros(F.lit(high)) if instant else F.lit(high).cast(kind)))


def backfill_window(df: DataFrame, start: Any, end: Any, partition_col: str) -> DataFrame:
    """Rows of the partitions from ``start`` to ``end``, both included."""
    return df.where(F.col(partition_col).between(F.lit(start), F.lit(end)))


def incremental_load(
    target: DataFrame,
    source: DataFrame,
    spec: IncrementalSpec,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The target with the newer source rows appended.

    ``deduplicate`` keeps one new row per ``dedup_keys``, or drops exact
    copies where no keys are declared.
    """
    new = incremental_filter(source, target, spec.watermark_column)
    if spec.deduplicate:
        new = preset_dedup(new, spec.dedup_keys, order_by) if spec.dedup_keys else new.dropDuplicates()
    return target.unionByName(new.select(*target.columns))
