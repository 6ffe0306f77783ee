"""Registered queries over the test tables, with their SQL twins."""

from flowtally.queries import folds, loads, lookups, quality, reconcile, records, scalars, scoring
from flowtally.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "folds", "loads", "lookups", "quality", "reconcile", "records", "scalars", "scoring"]
