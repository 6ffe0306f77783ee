"""Nodes and edges of the findings of build plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values
DEFAULT_CODE = "advisor.finding"
DEFAULT_SEVERITY = "warn"

_ATTRIBUTES = ("job_name", "code", "severity", "message")


def _plan_node() -> Column:
    return F.concat(F.lit("plan:"), F.col("plan_id"))


def _code() -> Column:
    return F.coalesce(F.col("code"), F.lit(DEFAULT_CODE))


def _finding_key() -> Column:
    return F.concat(_code(), F.lit(":"), F.substring(F.coalesce(F.col("message"), F.lit("")), 1, 60))


def _paths(findings: DataFrame) -> Column:
    """Distinct paths from whichever of ``path``, ``file``, ``paths`` and ``files`` exist."""
    parts = [F.array(F.col(c)) for c in ("path", "file") if c in findings.columns]
    parts += [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("paths", "files") if c in findings.columns]
    if not parts:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))


def impact_nodes(findings: DataFrame, order: str = "seq") -> DataFrame:
    """Plan, finding and path nodes of each plan; the first occurrence gives the attributes.

    Each kind is grouped on its own, so a row that is shuffled holds its key
    and the attributes of its kind once; paths have no attributes and no order.
    """
    message = F.coalesce(F.col("message"), F.lit(""))
    severity = F.coalesce(F.col("severity"), F.lit(DEFAULT_SEVERITY))

    def first(*attributes: Column) -> Column:
        return F.min(F.struct(F.col(order).alias("__o"), *attributes)).alias("__n")

    def nodes(kind: str, found: DataFrame, key: Column) -> DataFrame:
        held = found.schema["__n"].dataType.names if "__n" in found.columns else []
        text = {c: (F.col(f"__n.{c}") if c in held else F.lit(None)).cast("string").alias(c) for c in _ATTRIBUTES}
        key = key.cast("string")
        return found.select(
            "plan_id", F.concat(F.lit(kind + ":"), key).alias("id"), F.lit(kind).alias("kind"), key.alias("key"), *text.values()
        )

    plans = findings.groupBy("plan_id").agg(first(F.col("job_name")))
    found = findings.groupBy("plan_id", _finding_key().alias("__k")).agg(
        first(_code().alias("code"), severity.alias("severity"), message.alias("message"))
    )
    paths = findings.select("plan_id", F.explode(_paths(findings)).alias("__k")).distinct()
    return (
        nodes("plan", plans, F.col("plan_id"))
        .unionByName(nodes("finding", found, F.col("__k")))
        .unionByName(nodes("path", paths, F.col("__k")))
    )


def impact_edges(findings: DataFrame) -> DataFrame:
    """``has_finding`` from plan to finding and ``touches`` from finding to path, one per finding."""
    finding = F.concat(F.lit("finding:"), _finding_key())

    def edge(source: Column, target: Column, kind: str) -> Column:
        return F.struct(source.alias("from"), target.alias("to"), F.lit(kind).alias("type"))

    edges = F.concat(
        F.array(edge(_plan_node(), finding, "has_finding")),
        F.transform(_paths(findings), lambda p: edge(finding, F.concat(F.lit("path:"), p), "touches")),
    )
    return findings.select("plan_id", F.explode(edges).alias("__e")).select("plan_id", "__e.*")
