"""Set operations on keys and events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def keys_added(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``b`` that ``a`` does not have."""
    return b.select(*keys).subtract(a.select(*keys))


def keys_removed(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` does not have."""
    return a.select(*keys).subtract(b.select(*keys))


def keys_common(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def union_events(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a column that a part lacks is NULL there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def distinct_paths(df: DataFrame, column: str = "path") -> DataFrame:
    return df.select(column).distinct().orderBy(column)
