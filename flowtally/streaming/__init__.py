"""Structured Streaming twins of the batch operators."""

from flowtally.streaming.counts import stream_audit_counts
from flowtally.streaming.folds import stream_rate_limit, stream_request_commands, stream_stale_runs
from flowtally.streaming.loads import (
    read_cdc_table,
    read_scd2_history,
    stream_budget_admission,
    stream_cdc_apply,
    stream_incremental_dedup,
    stream_late_scd2,
)

__all__ = [
    "read_cdc_table",
    "read_scd2_history",
    "stream_audit_counts",
    "stream_budget_admission",
    "stream_cdc_apply",
    "stream_incremental_dedup",
    "stream_late_scd2",
    "stream_rate_limit",
    "stream_request_commands",
    "stream_stale_runs",
]
