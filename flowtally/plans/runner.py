"""Run one table load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtally.plans.presets import apply_preset
from flowtally.plans.spec import WRITE_MODES, PipelineSpec
from flowtally.sinks.writes import current_version, merge_upsert, publish_version, read_current, write_append, write_overwrite
from flowtally.sources.tables import read_table


def run_pipeline(spark: SparkSession, spec: PipelineSpec) -> DataFrame:
    """Read, transform, write by mode, and return the target as it is now.

    ``merge`` writes a new version below the target path; plain parquet
    tables cannot be merged in place.
    """
    if spec.write_mode not in WRITE_MODES:
        raise ValueError(f"no such write mode: {spec.write_mode!r}")
    out = apply_preset(read_table(spark, spec.source_table), spec)
    if spec.write_mode == "overwrite":
        write_overwrite(out, spec.target_table, [spec.partition_column])
    elif spec.write_mode == "append":
        write_append(out, spec.target_table, [spec.partition_column])
    else:
        if "/" not in spec.target_table:
            raise ValueError("merge needs a target path; plain parquet tables reject MERGE")
        version = current_version(spark, spec.target_table)
        target = read_current(spark, spec.target_table)
        base = out.limit(0) if target is None else target
        merged = merge_upsert(base, out, spec.keys, spec.order_by or None)
        publish_version(merged, spec.target_table, 0 if version is None else version + 1)
        return read_current(spark, spec.target_table)
    return read_table(spark, spec.target_table)
