"""Declared transformation steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """``select{cols}``, ``filter{condition}``, ``join{table,on,how}`` or ``aggregate{group_by,aggs}``."""

    name: str
    type: str
    config: Mapping[str, Any] = field(default_factory=dict)


def _strings(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _one(df: DataFrame, step: Step, tables: Mapping[str, DataFrame]) -> DataFrame:
    cfg = step.config
    if step.type == "select":
        return df.select(*_strings(cfg["cols"]))
    if step.type == "filter":
        return df.where(cfg["condition"])
    if step.type == "join":
        other = tables[cfg.get("table", step.name)]
        return df.join(other, _strings(cfg["on"]), cfg.get("how", "inner"))
    if step.type == "aggregate":
        aggs = cfg.get("aggs") or {"count": "count(1)"}
        return df.groupBy(*_strings(cfg.get("group_by", []))).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    raise ValueError(f"unknown transformation type {step.type!r} in step {step.name!r}")


def apply_steps(df: DataFrame, steps: Sequence[Step], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Fold the steps into one plan; Catalyst sees it whole."""
    for step in steps:
        df = _one(df, step, tables or {})
    return df
