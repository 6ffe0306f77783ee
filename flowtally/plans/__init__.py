"""Table loads: presets, declared steps, slowly changing dimensions, change data, increments."""

from flowtally.plans.cdc import cdc_apply, latest_changes
from flowtally.plans.incremental import backfill_window, incremental_filter, incremental_load
from flowtally.plans.late import late_arrival_scd2
from flowtally.plans.materialize import materialize
from flowtally.plans.presets import (
    PRESETS,
    apply_preset,
    preset_cast,
    preset_copy,
    preset_dedup,
    preset_filter,
    preset_join,
    register_preset,
    with_run_ts,
)
from flowtally.plans.runner import run_pipeline
from flowtally.plans.scd import OPEN_END, scd1_apply, scd2_apply, scd2_initial, surrogate_key
from flowtally.plans.spec import (
    ChangeDetectionSpec,
    IncrementalSpec,
    ModelSpec,
    PipelineSpec,
    ScdSpec,
)
from flowtally.plans.steps import Step, apply_steps

__all__ = [
    "ChangeDetectionSpec",
    "IncrementalSpec",
    "ModelSpec",
    "OPEN_END",
    "PRESETS",
    "PipelineSpec",
    "ScdSpec",
    "Step",
    "apply_preset",
    "apply_steps",
    "backfill_window",
    "cdc_apply",
    "incremental_filter",
    "incremental_load",
    "late_arrival_scd2",
    "latest_changes",
    "materialize",
    "preset_cast",
    "preset_copy",
    "preset_dedup",
    "preset_filter",
    "preset_join",
    "register_preset",
    "run_pipeline",
    "scd1_apply",
    "scd2_apply",
    "scd2_initial",
    "surrogate_key",
    "with_run_ts",
]
