"""Slowly changing dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.hashing import change_hash
from flowtally.plans.spec import ScdSpec
from flowtally.sinks.writes import merge_upsert, unique_source

OPEN_END = "9999-12-31 00:00:00"


def surrogate_key(keys: Sequence[str], effective_from: str) -> Column:
    """Key that stays the same however often the load runs: hash of natural key and start time."""
    packed = F.struct(*[F.col(k) for k in keys], F.unix_micros(F.col(effective_from).cast("timestamp")).alias("__at"))
    return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)


def _versions(rows: DataFrame, spec: ScdSpec, as_of: Column) -> DataFrame:
    out = rows.withColumns(
        {
            spec.effective_from_col: as_of,
            spec.effective_to_col: F.lit(OPEN_END).cast("timestamp"),
            spec.current_flag_col: F.lit(True),
        }
    )
    if spec.surrogate_key:
        out = out.withColumn(spec.surrogate_key, surrogate_key(spec.natural_keys, spec.effective_from_col))
    return out


def scd2_initial(rows: DataFrame, spec: ScdSpec, as_of: datetime | str) -> DataFrame:
    """First load: every row becomes the open version of its key."""
    return _versions(rows, spec, F.lit(as_of).cast("timestamp"))


def scd2_apply(
    target: DataFrame,
    staging: DataFrame,
    spec: ScdSpec,
    as_of: datetime | str,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The target after one staging load.

    Changed keys: the open version ends at ``as_of`` and a new one starts.
    New keys: a version starts.  Unchanged keys, keys that are not staged and
    history stay as they are.  Only open versions are joined; closed history
    passes by without a shuffle.  Both join sides hold one row per key.
    """
    if spec.type != "scd2":
        raise ValueError("spec is no SCD2 configuration")
    at = F.lit(as_of).cast("timestamp")
    flag, end = spec.current_flag_col, spec.effective_to_col
    keys = list(spec.natural_keys)
    tracked = spec.change_detection.columns
    business = [c for c in target.columns if c not in spec.added_columns]

    def mark(df: DataFrame, name: str) -> DataFrame:
        if spec.change_detection.strategy == "hash":
            return df.withColumn(name, change_hash(tracked))
        return df.withColumn(name, F.struct(*tracked))

    is_open = F.coalesce(F.col(flag), F.lit(False))
    history = target.where(~is_open)
    old = mark(target.where(is_open), "__old").select(*keys, F.struct(*target.columns).alias("__t"), "__old")
    new = mark(unique_source(staging.select(*business), keys, order_by), "__new").select(
        *keys, F.struct(*business).alias("__s"), "__new"
    )
    pairs = old.join(new, keys, "full_outer")
    has_old, has_new = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    changed = has_old & has_new & ~F.col("__old").eqNullSafe(F.col("__new"))
    kept = F.when(changed, F.col("__t").withField(end, at).withField(flag, F.lit(False))).otherwise(F.col("__t"))

    fresh_row = _fresh(target, spec, at)
    # zero, one or two rows per pair, without joining a second time
    versions = F.array_compact(F.array(F.when(has_old, kept), F.when(changed | ~has_old, fresh_row)))
    touched = pairs.select(F.explode(versions).alias("__v")).select("__v.*")
    return history.unionByName(touched)


def _fresh(target: DataFrame, spec: ScdSpec, at: Column) -> Column:
    """Open version built from the staged struct ``__s``, in target column order."""
    special = {
        spec.effective_from_col: at,
        spec.effective_to_col: F.lit(OPEN_END).cast("timestamp"),
        spec.current_flag_col: F.lit(True),
    }
    if spec.surrogate_key:
        packed = F.struct(
            *[F.col("__s")[k].alias(k) for k in spec.natural_keys], F.unix_micros(at).alias("__at")
        )
        special[spec.surrogate_key] = F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)
    fields = []
    for field in target.schema.fields:
        value = special[field.name] if field.name in special else F.col("__s")[field.name]
        fields.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*fields)


def scd1_apply(
    target: DataFrame,
    staging: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Overwrite in place: no history."""
    return merge_upsert(target, staging, keys, order_by)
