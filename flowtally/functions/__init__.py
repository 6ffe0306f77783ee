"""Column functions; all native expressions, no Python on executors."""

from flowtally.functions.hashing import change_hash, content_hash
from flowtally.functions.jsondiff import json_diff, json_parseable
from flowtally.functions.requirement import extract_spec
from flowtally.functions.scalars import (
    audit_actor,
    audit_details,
    audit_event,
    classify_error,
    display_ts,
    explain_finding,
    glob_match,
    glob_regex,
    is_json_object,
    markdown_headers,
    month_key,
    normalize_path,
    normalize_risk,
    normalize_triage,
    numeric_or_null,
    parse_iso_utc,
    parse_json,
    safe_identifier,
    scope_for_path,
    token_cost,
    token_count,
    tokens,
    valid_cron,
    valid_job_name,
    valid_table,
)

__all__ = [
    "audit_actor",
    "audit_details",
    "audit_event",
    "change_hash",
    "classify_error",
    "content_hash",
    "display_ts",
    "explain_finding",
    "extract_spec",
    "glob_match",
    "glob_regex",
    "is_json_object",
    "json_diff",
    "json_parseable",
    "markdown_headers",
    "month_key",
    "normalize_path",
    "normalize_risk",
    "normalize_triage",
    "numeric_or_null",
    "parse_iso_utc",
    "parse_json",
    "safe_identifier",
    "scope_for_path",
    "token_cost",
    "token_count",
    "tokens",
    "valid_cron",
    "valid_job_name",
    "valid_table",
]
