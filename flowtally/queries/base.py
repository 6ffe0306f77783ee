"""Registry, table access and the record tables derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in the checking engine's SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def day(name: str):
    """A timestamp as text, so both engines print it alike."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


# Cost ledger out of orders: several orders share an entry, so entries get replaced
LEDGER_SQL = """
ledger_log AS (
  SELECT o_orderkey AS seq,
         't' || (o_custkey % 5) AS tenant,
         strftime(o_orderdate, '%Y-%m') AS month,
         't' || (o_custkey % 5) || ':' || (o_orderkey // 8) AS entry_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'ai_task_' || substr(o_orderpriority, 1, 1)
              ELSE 'job_' || (o_orderkey % 7) END AS job_name,
         o_totalprice / 1000 AS estimated_cost_usd,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 END AS actual_cost_usd
  FROM orders)
"""


def ledger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tenant = F.concat(F.lit("t"), F.col("o_custkey") % 5)
    return o.select(
        F.col("o_orderkey").alias("seq"),
        tenant.alias("tenant"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.concat(tenant, F.lit(":"), F.expr("o_orderkey div 8")).alias("entry_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("ai_task_"), F.substring("o_orderpriority", 1, 1)))
        .otherwise(F.concat(F.lit("job_"), F.col("o_orderkey") % 7))
        .alias("job_name"),
        (F.col("o_totalprice") / 1000).alias("estimated_cost_usd"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 1000).alias("actual_cost_usd"),
    )


# Limits per tenant out of customers; tenant t4 has none
BUDGETS_SQL = """
budgets AS (
  SELECT 't' || (c_custkey % 5) AS tenant, max(c_acctbal) AS limit_usd
  FROM customer WHERE c_custkey % 5 <> 4 GROUP BY 1)
"""


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 4")
    return c.groupBy(F.concat(F.lit("t"), F.col("c_custkey") % 5).alias("tenant")).agg(
        F.max("c_acctbal").alias("limit_usd")
    )


# Requests out of events
REQUESTS_SQL = """
requests AS (
  SELECT event_id, ts, user_id, value,
         CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'POST' WHEN 'purchase' THEN 'put'
                         WHEN 'signup' THEN NULL ELSE 'DELETE' END AS method,
         '/api/v1/users/' || user_id || '/items' AS path,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'error' THEN 500 ELSE 200 END AS status
  FROM events)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    method = (
        F.when(kind == "view", "get")
        .when(kind == "click", "POST")
        .when(kind == "purchase", "put")
        .when(kind == "signup", F.lit(None))
        .otherwise("DELETE")
    )
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "value",
        method.alias("method"),
        F.concat(F.lit("/api/v1/users/"), "user_id", F.lit("/items")).alias("path"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(kind == "error", 500).otherwise(200).alias("status"),
    )


# Column catalog out of part: a supplier-like group is a table, each part a column
CATALOG_SQL = """
catalog AS (
  SELECT 'tab_' || (p_partkey // 9) AS table_name,
         CASE p_partkey % 23 WHEN 0 THEN 'event_date' WHEN 1 THEN 'ingestion_date' WHEN 2 THEN 'created_at'
              WHEN 3 THEN 'customer_id' WHEN 4 THEN 'id' ELSE 'col_' || p_partkey END AS column_name,
         CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'double' WHEN 2 THEN 'string' ELSE 'timestamp' END AS data_type,
         p_partkey, p_size
  FROM part)
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.selectExpr(
        "concat('tab_', p_partkey div 9) AS table_name",
        """CASE p_partkey % 23 WHEN 0 THEN 'event_date' WHEN 1 THEN 'ingestion_date' WHEN 2 THEN 'created_at'
           WHEN 3 THEN 'customer_id' WHEN 4 THEN 'id' ELSE concat('col_', p_partkey) END AS column_name""",
        "CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'double' WHEN 2 THEN 'string' ELSE 'timestamp' END AS data_type",
        "p_partkey",
        "p_size",
    )
