"""Data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtally.queries.base import CATALOG_SQL, catalog, query, table
from flowtally.quality import (
    check_duplicates,
    check_freshness,
    check_non_negative,
    check_not_null,
    check_null_threshold,
    infer_rules,
    run_checks,
    suggest_checks,
    validate_rules,
)


@query(
    "dq_infer_rules",
    f"""WITH {CATALOG_SQL}
        SELECT table_name, column_name, 'not_null' AS rule_type FROM catalog
        UNION ALL
        SELECT table_name, column_name, 'non_negative' FROM catalog WHERE data_type IN ('int', 'double')""",
)
def _(spark, sf):
    return infer_rules(catalog(spark, sf))


@query(
    "dq_validate_rules",
    f"""WITH {CATALOG_SQL}, rules AS (
          SELECT table_name, CASE WHEN p_partkey % 5 <> 0 THEN column_name END AS column_name,
                 CASE WHEN p_partkey % 2 = 0 THEN 'not_null' ELSE 'non_negative' END AS rule_type FROM catalog)
        SELECT *, CASE WHEN rule_type = 'not_null' AND column_name IS NULL THEN 'invalid' ELSE 'valid' END AS status,
               CASE WHEN rule_type = 'not_null' AND column_name IS NULL THEN 'missing column' END AS reason
        FROM rules""",
)
def _(spark, sf):
    rules = catalog(spark, sf).select(
        "table_name",
        F.when(F.col("p_partkey") % 5 != 0, F.col("column_name")).alias("column_name"),
        F.when(F.col("p_partkey") % 2 == 0, "not_null").otherwise("non_negative").alias("rule_type"),
    )
    return validate_rules(rules)


def _gaps(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity")).alias("qty"),
        (F.col("l_extendedprice") - 20000).alias("margin"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_returnflag")).alias("flag"),
        "l_orderkey",
    )


GAPS_SQL = """
gaps AS (
  SELECT CASE WHEN l_partkey % 10 <> 0 THEN l_quantity END AS qty, l_extendedprice - 20000 AS margin,
         CASE WHEN l_suppkey % 3 = 0 THEN l_returnflag END AS flag, l_orderkey FROM lineitem)
"""


@query(
    "dq_check_not_null",
    f"""WITH {GAPS_SQL}
        SELECT 'not_null' AS rule_type, c AS column_name, bad AS violations, n AS row_count, bad = 0 AS passed FROM (
          SELECT 'qty' AS c, count(*) FILTER (qty IS NULL) AS bad, count(*) AS n FROM gaps
          UNION ALL SELECT 'l_orderkey', count(*) FILTER (l_orderkey IS NULL), count(*) FROM gaps)""",
)
def _(spark, sf):
    return check_not_null(_gaps(spark, sf), ["qty", "l_orderkey"])


@query(
    "dq_check_non_negative",
    f"""WITH {GAPS_SQL}
        SELECT 'non_negative' AS rule_type, c AS column_name, bad AS violations, n AS row_count, bad = 0 AS passed FROM (
          SELECT 'qty' AS c, count(*) FILTER (qty < 0) AS bad, count(*) AS n FROM gaps
          UNION ALL SELECT 'margin', count(*) FILTER (margin < 0), count(*) FROM gaps)""",
)
def _(spark, sf):
    return check_non_negative(_gaps(spark, sf), ["qty", "margin"])


@query(
    "dq_check_null_threshold",
    f"""WITH {GAPS_SQL}
        SELECT 'null_threshold' AS rule_type, c AS column_name, bad AS violations, n AS row_count, ok AS passed FROM (
          SELECT 'qty' AS c, count(*) FILTER (qty IS NULL) AS bad, count(*) AS n,
                 avg(CASE WHEN qty IS NULL THEN 1.0 ELSE 0 END) <= 0.2 AS ok FROM gaps
          UNION ALL SELECT 'flag', count(*) FILTER (flag IS NULL), count(*),
                 avg(CASE WHEN flag IS NULL THEN 1.0 ELSE 0 END) <= 0.5 FROM gaps)""",
)
def _(spark, sf):
    return check_null_threshold(_gaps(spark, sf), {"qty": 0.2, "flag": 0.5})


@query(
    "dq_all_rules_in_one_pass",
    f"""WITH {GAPS_SQL}
        SELECT r AS rule_type, c AS column_name, bad AS violations, n AS row_count, ok AS passed FROM (
          SELECT 'not_null' AS r, 'qty' AS c, count(*) FILTER (qty IS NULL) AS bad, count(*) AS n,
                 count(*) FILTER (qty IS NULL) = 0 AS ok FROM gaps
          UNION ALL SELECT 'non_negative', 'margin', count(*) FILTER (margin < 0), count(*),
                 count(*) FILTER (margin < 0) = 0 FROM gaps
          UNION ALL SELECT 'null_threshold', 'flag', count(*) FILTER (flag IS NULL), count(*),
                 avg(CASE WHEN flag IS NULL THEN 1.0 ELSE 0 END) <= 0.5 FROM gaps)""",
)
def _(spark, sf):
    return run_checks(_gaps(spark, sf), ["qty"], ["margin"], {"flag": 0.5})


@query(
    "dq_check_duplicates",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
       GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, sf):
    return check_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dq_check_freshness",
    """SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest,
              round(date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01') / 60000000.0::DOUBLE, 6) AS age_minutes,
              date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01') <= 3600000000 AS passed
       FROM events""",
)
def _(spark, sf):
    out = check_freshness(table(spark, sf, "events"), "ts", "2024-02-01 00:00:00", 60)
    return out.select(
        F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"),
        F.round("age_minutes", 6).alias("age_minutes"),
        "passed",
    )


@query(
    "dq_suggest_checks",
    f"""WITH {CATALOG_SQL}, models AS (
          SELECT table_name, CASE count(*) % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' WHEN 2 THEN 'scd1'
                             ELSE 'scd2' END AS model_type,
                 count(*) FILTER (data_type = 'string') AS column_count FROM catalog GROUP BY 1)
        SELECT *, 'freshness_check'
               || CASE WHEN model_type IN ('scd2', 'incremental') THEN ',duplicate_check' ELSE '' END
               || CASE WHEN column_count > 0 THEN ',null_threshold_check' ELSE '' END AS checks
        FROM models""",
)
def _(spark, sf):
    kinds = F.count(F.lit(1)) % 4
    models = catalog(spark, sf).groupBy("table_name").agg(
        F.when(kinds == 0, "full").when(kinds == 1, "incremental").when(kinds == 2, "scd1").otherwise("scd2").alias(
            "model_type"
        ),
        F.count_if(F.col("data_type") == "string").alias("column_count"),
    )
    return suggest_checks(models).withColumn("checks", F.array_join("checks", ","))
