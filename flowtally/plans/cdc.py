"""Change data capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last change of each key; changes with a NULL in the key belong to no key and all stay.

    The rank filter is applied in each task before the shuffle as well, and
    changes without a key are not shuffled.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    ranked = changes.where(known).withColumn("__n", F.row_number().over(last)).where(F.col("__n") == 1).drop("__n")
    return ranked.unionByName(changes.where(~known))


def cdc_apply(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    op_col: str = "op",
) -> DataFrame:
    """The target after the changes: matched ``D`` deletes, other matched rows replace, the rest inserts.

    Deletes of absent keys do nothing, and ``op_col`` is not stored.  A NULL in
    the key matches nothing, as in ``merge_upsert``: such a delete does nothing
    and any other such change is inserted.
    """
    last = latest_changes(changes, keys, order)
    kept = target.join(changes.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns)
    upserts = last.where(F.coalesce(F.col(op_col) != "D", F.lit(True)))
    return kept.unionByName(upserts.select(*target.columns))
