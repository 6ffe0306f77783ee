"""Dispatch of a model to its load."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from flowtally.plans.incremental import incremental_load
from flowtally.plans.scd import scd1_apply, scd2_apply
from flowtally.plans.spec import ModelSpec


def materialize(
    spec: ModelSpec,
    source: DataFrame,
    target: DataFrame,
    as_of: datetime | str | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The new content of the model's table."""
    rows = source.select(*spec.columns)
    if spec.model_type == "full":
        return rows
    if spec.model_type == "incremental":
        if spec.incremental is None:
            raise ValueError("an incremental model needs its watermark column")
        return incremental_load(target, rows, spec.incremental, order_by or ())
    if spec.scd is None:
        raise ValueError(f"model type {spec.model_type!r} needs an SCD configuration")
    if spec.model_type == "scd1":
        return scd1_apply(target, rows, spec.scd.natural_keys, order_by)
    if spec.model_type == "scd2":
        if as_of is None:
            raise ValueError("an SCD2 load needs as_of")
        return scd2_apply(target, rows, spec.scd, as_of, order_by)
    raise ValueError(f"unknown model type {spec.model_type!r}")
