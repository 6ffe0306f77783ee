"""Rules from column catalogs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INT_TYPES = ("int", "integer", "tinyint", "smallint", "bigint", "long")
FLOAT_TYPES = ("float", "double", "decimal")


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, position) of some tables; reads schemas only."""
    rows = [
        (name, field.name, field.dataType.simpleString(), i)
        for name, df in tables.items()
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def infer_rules(columns: DataFrame) -> DataFrame:
    """(table_name, column_name, rule_type): numbers get ``non_negative`` and ``not_null``, others ``not_null``."""
    kind = F.regexp_extract(F.lower("data_type"), "^[a-z]+", 0)
    numeric = kind.isin(*INT_TYPES, *FLOAT_TYPES)
    rules = F.array_compact(F.array(F.when(numeric, "non_negative"), F.lit("not_null")))
    return columns.select("table_name", "column_name", F.explode(rules).alias("rule_type"))


def validate_rules(rules: DataFrame) -> DataFrame:
    """Add ``status`` and ``reason``: ``not_null`` needs a column."""
    bad = (F.col("rule_type") == "not_null") & (F.coalesce(F.length("column_name"), F.lit(0)) == 0)
    bad = F.coalesce(bad, F.lit(False))
    return rules.withColumns(
        {
            "status": F.when(bad, "invalid").otherwise("valid"),
            "reason": F.when(bad, "missing column"),
        }
    )


def suggest_checks(models: DataFrame) -> DataFrame:
    """Add ``checks`` to models (model_type, column_count)."""
    checks = F.array_compact(
        F.array(
            F.lit("freshness_check"),
            F.when(F.col("model_type").isin("scd2", "incremental"), "duplicate_check"),
            F.when(F.col("column_count") > 0, "null_threshold_check"),
        )
    )
    return models.withColumn("checks", checks)
