"""Named tables and parquet paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """A catalog table ``db.table`` or view, or a parquet path (anything with a ``/``)."""
    if "/" in source:
        return spark.read.parquet(source)
    return spark.table(source)
