"""Named DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.plans.spec import PipelineSpec
from flowtally.sources.tables import read_table


def preset_copy(df: DataFrame) -> DataFrame:
    return df


def preset_filter(df: DataFrame, partition_col: str) -> DataFrame:
    """Rows whose partition column is set."""
    return df.where(F.col(partition_col).isNotNull())


def preset_dedup(df: DataFrame, column: str | Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per value: the first by ``order_by``, ties broken by all columns.

    The rank filter runs once per task before the shuffle, so a hot value
    sends one row per task.
    """
    keys = [column] if isinstance(column, str) else list(column)
    order = [*order_by, *[c for c in df.columns if c not in order_by and c not in keys]] or keys
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n")


def preset_cast(df: DataFrame) -> DataFrame:
    """All columns as strings."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def preset_join(df: DataFrame, lookup: DataFrame | None, join_key: str | Sequence[str]) -> DataFrame:
    """Left join to a lookup table; no lookup means no change.

    Spark picks the join by size; AQE splits a hot key of the left side.
    """
    if lookup is None:
        return df
    return df.join(lookup, [join_key] if isinstance(join_key, str) else list(join_key), "left")


def with_run_ts(df: DataFrame, ts: datetime | str, column: str = "run_ts") -> DataFrame:
    """Stamp the rows with the time of the run, which the caller passes in."""
    return df.withColumn(column, F.lit(ts).cast("timestamp"))


Preset = Callable[[DataFrame, PipelineSpec], DataFrame]


def _join(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    name = spec.metadata.get("lookup_table", "")
    lookup = read_table(df.sparkSession, name) if name else None
    return preset_join(df, lookup, spec.metadata.get("join_key", spec.partition_column))


PRESETS: dict[str, Preset] = {
    "generic": lambda df, spec: df,
    "enterprise_a": lambda df, spec: df,
    "enterprise_b": lambda df, spec: df,
    "copy": lambda df, spec: df,
    "filter": lambda df, spec: preset_filter(df, spec.partition_column),
    "dedup": lambda df, spec: preset_dedup(df, spec.partition_column, spec.order_by),
    "cast": lambda df, spec: preset_cast(df),
    "join": _join,
}


def register_preset(name: str, fn: Preset) -> None:
    """Add or replace a named transform ``fn(df, spec) -> df``."""
    PRESETS[name] = fn


def apply_preset(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    """The preset the spec names; an unknown name passes the rows through."""
    fn = PRESETS.get(spec.preset)
    return df if fn is None else fn(df, spec)
