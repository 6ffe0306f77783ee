"""Cost, risk, decision and sizing of jobs, one row per job."""

from flowtally.scoring.cost import cost_cloud, cost_cluster, cost_columns, cost_preflight
from flowtally.scoring.decide import (
    approval_required,
    decide_execution,
    decide_preflight,
    decide_thresholds,
    spec_policy,
    threshold_violations,
)
from flowtally.scoring.risk import risk_plan, risk_preflight
from flowtally.scoring.sizing import job_sizing, join_advice, partition_advice, tuning_hints

__all__ = [
    "approval_required",
    "cost_cloud",
    "cost_cluster",
    "cost_columns",
    "cost_preflight",
    "decide_execution",
    "decide_preflight",
    "decide_thresholds",
    "job_sizing",
    "join_advice",
    "partition_advice",
    "risk_plan",
    "risk_preflight",
    "spec_policy",
    "threshold_violations",
    "tuning_hints",
]
