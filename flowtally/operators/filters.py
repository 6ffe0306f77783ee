"""Filters over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.scalars import audit_actor, audit_event


def for_tenant_month(df: DataFrame, tenant: str, month: str) -> DataFrame:
    """Rows of one tenant and month; prunes partitions where the table has them."""
    return df.where((F.col("tenant") == tenant) & (F.col("month") == month))


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def audit_filter(df: DataFrame, tenant: str = "", actor: str = "", event: str = "") -> DataFrame:
    """Case-insensitive substring per field; an empty filter matches all."""
    conditions = (
        (tenant, F.coalesce(_or_null(df, "tenant"), F.lit(""))),
        (actor, audit_actor(_or_null(df, "actor"), _or_null(df, "user"))),
        (event, audit_event(_or_null(df, "event_type"), _or_null(df, "event"), _or_null(df, "type"))),
    )
    for wanted, value in conditions:
        if wanted:
            df = df.where(F.lower(value).contains(wanted.lower()))
    return df
