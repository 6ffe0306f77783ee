"""Registry of the queries of this subpackage and what its operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.queries.base import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ASCII white space; a word is a run of anything else
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

__all__ = ["QUERIES", "SQL", "Query", "SPACE", "SPACE_CHARS", "column", "free_names", "hash_bound", "query", "table", "words_of"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in the checking engine's SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def hash_bound(picks: DataFrame, n: int) -> int | None:
    """The n-th smallest value of the column ``pick``; None for no rows.

    Only this column goes through the sort, so that a bounded sample of wide
    rows is a plain filter afterwards and no task gathers a part of each partition.
    """
    return picks.orderBy("pick").limit(n).agg(F.max("pick")).first()[0]


def column(name: str):
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The given names for helper columns, made longer until none clashes with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text):
    """The words of a text as an array; empty for NULL or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+", -1))
