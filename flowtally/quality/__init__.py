"""Data quality rules and checks."""

from flowtally.quality.checks import (
    check_duplicates,
    check_freshness,
    check_non_negative,
    check_not_null,
    check_null_threshold,
    run_checks,
)
from flowtally.quality.rules import column_catalog, infer_rules, suggest_checks, validate_rules

__all__ = [
    "check_duplicates",
    "check_freshness",
    "check_non_negative",
    "check_not_null",
    "check_null_threshold",
    "column_catalog",
    "infer_rules",
    "run_checks",
    "suggest_checks",
    "validate_rules",
]
