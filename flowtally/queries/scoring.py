"""Cost, risk, decisions and sizing over job tables derived from orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally import scoring as sc
from flowtally.queries.base import BUDGETS_SQL, CATALOG_SQL, LEDGER_SQL, budgets, catalog, ledger_log, query, table
from flowtally.queries.lookups import CLOUD_JOBS_SQL, PRICES_SQL, cloud_jobs, overrides


@query(
    "cost_cloud",
    f"""WITH {PRICES_SQL}, {CLOUD_JOBS_SQL}, j AS (
          SELECT *, lower(provider) AS p, coalesce(region, CASE WHEN lower(provider) = 'k8s' THEN 'default' ELSE 'us-east-1' END) AS used
          FROM jobs),
        c AS (
          SELECT j.*, greatest(executors, 1) * greatest(vcpu_per_executor, 0.5::DOUBLE)
                 * (coalesce(a.price, b.price, 0.05::DOUBLE) * CASE WHEN spot THEN 1.0::DOUBLE - 0.6::DOUBLE ELSE 1.0::DOUBLE END)
                 * (greatest(runtime_minutes, 1.0::DOUBLE) / 60) AS cost
          FROM j LEFT JOIN book a ON a.provider = j.p AND a.region = j.used
                 LEFT JOIN book b ON b.provider = j.p AND b.region = 'default')
        SELECT c_custkey, round(cost, 4) AS compute_cost_usd, round(cost * 0.08::DOUBLE, 4) AS infra_cost_usd,
               round(cost + cost * 0.08::DOUBLE, 4) AS estimated_total_cost_usd,
               round(0.80::DOUBLE - CASE WHEN region IS NULL THEN 0.05::DOUBLE ELSE 0 END
                     - CASE WHEN instance_type IS NULL THEN 0.05::DOUBLE ELSE 0 END, 3) AS cost_confidence
        FROM c""",
)
def _(spark, sf):
    out = sc.cost_cloud(cloud_jobs(spark, sf), overrides(spark, sf))
    return out.select(
        "c_custkey", "compute_cost_usd", "infra_cost_usd", "estimated_total_cost_usd", "cost_confidence"
    )


# Preflight jobs out of orders; sizes are odd on purpose, see below
PREFLIGHT_SQL = """
jobs AS (
  SELECT o_orderkey, o_totalprice / 1000 + 0.001371::DOUBLE AS gb, 1 + o_orderkey % 5 AS shuffle, 1 + o_custkey % 40 AS executors,
         (o_custkey % 10) / 2.0::DOUBLE AS rate, CASE o_orderkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 0 END AS sla
  FROM orders),
est AS (SELECT *, greatest(1.0::DOUBLE, gb * shuffle / greatest(0.5::DOUBLE, executors) * 5) AS m FROM jobs),
costed AS (
  SELECT *, round(m, 2) AS runtime_minutes, round(m / 60 * executors * rate, 2) AS compute_cost_usd,
         CASE WHEN gb > 100 THEN 0.6::DOUBLE WHEN gb < 10 THEN 0.85 ELSE 0.7 END AS confidence FROM est),
flags AS (
  SELECT *, coalesce(sla <> 0 AND runtime_minutes > sla, FALSE) AS late FROM costed),
risky AS (
  SELECT *, round(least(1.0::DOUBLE, CASE WHEN gb > 200 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN shuffle > 3 THEN 0.2::DOUBLE ELSE 0 END
           + CASE WHEN late THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN compute_cost_usd > 500 THEN 0.2::DOUBLE ELSE 0 END), 2) AS risk_score
  FROM flags)
"""


def _preflight(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k,
        (F.col("o_totalprice") / 1000 + 0.001371).alias("estimated_input_gb"),
        (1 + k % 5).cast("double").alias("shuffle_multiplier"),
        (1 + c % 40).alias("executors"),
        ((c % 10) / 2.0).alias("cost_per_executor_hour"),
        F.when(k % 3 == 0, 60).when(k % 3 == 1, 0).alias("max_runtime_minutes"),
    )


@query(
    "cost_preflight",
    f"WITH {PREFLIGHT_SQL} SELECT o_orderkey, runtime_minutes, compute_cost_usd, confidence FROM risky",
)
def _(spark, sf):
    out = sc.cost_preflight(_preflight(spark, sf))
    return out.select("o_orderkey", "runtime_minutes", "compute_cost_usd", "confidence")


@query(
    "risk_preflight",
    f"""WITH {PREFLIGHT_SQL} SELECT o_orderkey, risk_score, concat_ws(',', CASE WHEN gb > 200 THEN 'large_input_dataset' END,
          CASE WHEN shuffle > 3 THEN 'high_shuffle_multiplier' END, CASE WHEN late THEN 'sla_runtime_breach_predicted' END,
          CASE WHEN compute_cost_usd > 500 THEN 'high_cost_estimate' END) AS risk_reasons FROM risky""",
)
def _(spark, sf):
    out = sc.risk_preflight(sc.cost_preflight(_preflight(spark, sf)))
    return out.select("o_orderkey", "risk_score", F.array_join("risk_reasons", ",").alias("risk_reasons"))


@query(
    "decide_preflight",
    f"""WITH {PREFLIGHT_SQL} SELECT o_orderkey, CASE WHEN risk_score > 0.85 THEN 'BLOCK'
          WHEN compute_cost_usd > 300 OR late THEN 'WARN' ELSE 'ALLOW' END AS decision FROM risky""",
)
def _(spark, sf):
    out = sc.decide_preflight(sc.risk_preflight(sc.cost_preflight(_preflight(spark, sf))))
    return out.select("o_orderkey", "decision")


# Planned jobs out of line items: one job per order.  The rate is odd on
# purpose: the engines round exact halves of a cent differently.
PLAN_SQL = """
plan AS (
  SELECT l_orderkey, count(*) AS num_stages, count(DISTINCT l_returnflag) AS shuffle_stages,
         CAST(100 + sum(l_quantity) * 4 AS BIGINT) AS base_parallelism, CAST(max(l_linenumber) AS BIGINT) AS executor_instances,
         max(l_tax) * 100 + 0.1371::DOUBLE AS instance_hourly_rate, CAST(4 + min(l_linenumber) AS BIGINT) * 2 - 4 AS executor_memory_gb
  FROM lineitem GROUP BY 1),
timed AS (SELECT *, round((num_stages * 2.5::DOUBLE + shuffle_stages * 3) / greatest(1.0::DOUBLE, base_parallelism / 200), 2) AS runtime_minutes FROM plan),
costed AS (SELECT *, round(runtime_minutes / 60 * executor_instances * instance_hourly_rate, 2) AS cost_estimate_usd FROM timed),
scored AS (SELECT *, CASE WHEN shuffle_stages > 2 THEN 25 ELSE 0 END + CASE WHEN executor_memory_gb < 8 THEN 20 ELSE 0 END
             + CASE WHEN runtime_minutes > 60 THEN 20 ELSE 0 END AS risk_score FROM costed),
report AS (SELECT *, CASE WHEN risk_score < 30 THEN 'LOW' WHEN risk_score < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
             round(least(0.9::DOUBLE, risk_score / 100), 2) AS failure_probability,
             greatest(0.5::DOUBLE, round(1 - risk_score / 150, 2)) AS confidence_score FROM scored)
"""


def _plans(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("num_stages"),
        F.count_distinct("l_returnflag").alias("shuffle_stages"),
        (100 + F.sum("l_quantity") * 4).cast("bigint").alias("base_parallelism"),
        F.max("l_linenumber").cast("bigint").alias("executor_instances"),
        (F.max("l_tax") * 100 + 0.1371).alias("instance_hourly_rate"),
        ((4 + F.min("l_linenumber")).cast("bigint") * 2 - 4).alias("executor_memory_gb"),
    )


@query(
    "cost_cluster",
    f"WITH {PLAN_SQL} SELECT l_orderkey, runtime_minutes, cost_estimate_usd FROM report",
)
def _(spark, sf):
    return sc.cost_cluster(_plans(spark, sf)).select("l_orderkey", "runtime_minutes", "cost_estimate_usd")


@query(
    "risk_plan",
    f"""WITH {PLAN_SQL} SELECT l_orderkey, risk_score, risk_level, failure_probability, confidence_score,
          concat_ws(',', CASE WHEN shuffle_stages > 2 THEN 'High shuffle amplification' END,
            CASE WHEN executor_memory_gb < 8 THEN 'Low executor memory' END,
            CASE WHEN runtime_minutes > 60 THEN 'Long runtime risk' END) AS factors FROM report""",
)
def _(spark, sf):
    out = sc.risk_plan(sc.cost_cluster(_plans(spark, sf)))
    return out.select(
        "l_orderkey",
        "risk_score",
        "risk_level",
        "failure_probability",
        "confidence_score",
        F.array_join("factors", ",").alias("factors"),
    )


@query(
    "tuning_hints",
    f"""WITH {PLAN_SQL} SELECT l_orderkey, concat_ws(',', CASE WHEN shuffle_stages > 2 THEN 'Increase shuffle partitions,Enable Adaptive Query Execution' END,
          CASE WHEN executor_memory_gb < 8 THEN 'Increase executor memory to at least 8GB' END) AS hints FROM plan""",
)
def _(spark, sf):
    out = sc.tuning_hints(_plans(spark, sf))
    return out.select("l_orderkey", F.array_join("hints", ",").alias("hints"))


_LIMITS = {
    "max_cost_usd": 2.5,
    "max_risk_score": 40,
    "max_failure_probability": 0.4,
    "min_confidence_score": 0.9,
}
_HARD = "(cost_estimate_usd > 2.5 OR risk_score > 40 OR failure_probability > 0.4)"
_SOFT = "confidence_score < 0.9"


@query(
    "threshold_violations",
    f"""WITH {PLAN_SQL} SELECT l_orderkey, concat_ws(',', CASE WHEN cost_estimate_usd > 2.5 THEN 'cost_estimate_usd' END,
          CASE WHEN risk_score > 40 THEN 'risk_score' END, CASE WHEN failure_probability > 0.4 THEN 'failure_probability' END,
          CASE WHEN {_SOFT} THEN 'confidence_score' END) AS reasons FROM report""",
)
def _(spark, sf):
    out = sc.threshold_violations(sc.risk_plan(sc.cost_cluster(_plans(spark, sf))), _LIMITS)
    names = F.transform("reasons", lambda r: F.substring_index(r, " ", 1))
    return out.select("l_orderkey", F.array_join(names, ",").alias("reasons"))


@query(
    "decide_thresholds",
    f"""WITH {PLAN_SQL}
        SELECT l_orderkey, 'strict' AS mode, CASE WHEN {_HARD} OR {_SOFT} THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM report
        UNION ALL
        SELECT l_orderkey, 'balanced', CASE WHEN {_HARD} THEN 'BLOCK' WHEN {_SOFT} THEN 'WARN' ELSE 'ALLOW' END FROM report
        UNION ALL
        SELECT l_orderkey, 'permissive', CASE WHEN risk_score >= 90 OR failure_probability >= 0.6 THEN 'BLOCK'
               WHEN {_HARD} OR {_SOFT} THEN 'WARN' ELSE 'ALLOW' END FROM report""",
)
def _(spark, sf):
    jobs = sc.risk_plan(sc.cost_cluster(_plans(spark, sf)))
    parts = [
        sc.decide_thresholds(jobs, _LIMITS, mode).select("l_orderkey", F.lit(mode).alias("mode"), "decision")
        for mode in ("strict", "balanced", "permissive")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "decide_execution",
    f"""WITH {LEDGER_SQL}, {BUDGETS_SQL},
        spent AS (SELECT tenant, month, sum(estimated_cost_usd) AS used FROM ledger_log GROUP BY 1, 2),
        jobs AS (SELECT seq, tenant, month, estimated_cost_usd / 8 AS cost, seq % 250 AS minutes, seq % 230 AS executors,
                        CASE WHEN seq % 4 <> 0 THEN (seq % 100) / 100.0::DOUBLE END AS risk FROM ledger_log),
        j AS (SELECT jobs.*, coalesce(used, 0) AS used, coalesce(limit_usd, 250.0::DOUBLE) AS lim
              FROM jobs LEFT JOIN spent USING (tenant, month) LEFT JOIN budgets USING (tenant)),
        k AS (SELECT *, used >= lim AS gone, used < lim AND used + cost > lim AS over FROM j),
        t AS (SELECT seq, concat_ws(',', CASE WHEN cost > 50 THEN 'exec.cost.too_high' END,
                CASE WHEN minutes > 180 THEN 'exec.runtime.too_high' END, CASE WHEN executors > 200 THEN 'exec.executors.too_high' END,
                CASE WHEN gone OR over THEN 'exec.budget.exceeded' END) AS reasons,
              concat_ws(',', CASE WHEN NOT gone AND NOT over AND lim > 0 AND (used + cost) / lim >= 0.8 THEN 'exec.budget.near_limit' END,
                CASE WHEN risk >= 0.7 THEN 'exec.risk.high' END) AS warnings FROM k)
        SELECT *, CASE WHEN reasons <> '' THEN 'BLOCK' WHEN warnings <> '' THEN 'WARN' ELSE 'ALLOW' END AS decision FROM t""",
)
def _(spark, sf):
    log = ledger_log(spark, sf)
    k = F.col("seq")
    jobs = log.select(
        "seq",
        "tenant",
        "month",
        (F.col("estimated_cost_usd") / 8).alias("estimated_total_cost_usd"),
        (k % 250).alias("runtime_minutes"),
        (k % 230).alias("executors"),
        F.when(k % 4 != 0, (k % 100) / 100.0).alias("risk_score"),
    )
    out = sc.decide_execution(jobs, log, budgets(spark, sf))

    def codes(name: str):
        return F.array_join(F.transform(name, lambda n: n["code"]), ",").alias(name)

    return out.select("seq", codes("reasons"), codes("warnings"), "decision")


@query(
    "approval_required",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 9999 >= 0.7 ELSE FALSE END AS required,
         CASE WHEN c_custkey % 5 = 0 THEN 'risk_score_missing' WHEN c_acctbal / 9999 >= 0.7 THEN 'high_risk_requires_approval'
              ELSE 'risk_below_threshold' END AS approval_reason FROM customer""",
)
def _(spark, sf):
    risk = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 9999)
    jobs = table(spark, sf, "customer").select("c_custkey", risk.alias("risk_score"))
    return sc.approval_required(jobs).drop("risk_score")


@query(
    "job_sizing",
    """SELECT o_orderkey, greatest(2, CAST(trunc(gb / 5) AS INT)) AS executor_instances,
         CASE WHEN joins < 3 THEN 4 ELSE 6 END AS executor_cores, CASE WHEN gb < 50 THEN '8g' ELSE '14g' END AS executor_memory,
         greatest(200, CAST(trunc(gb * 4) AS INT)) AS shuffle_partitions, coalesce(sla <> 0 AND sla < 30, FALSE) AS speculation
       FROM (SELECT o_orderkey, o_totalprice / 2000 AS gb, o_custkey % 6 AS joins,
                    CASE WHEN o_orderkey % 4 <> 3 THEN (o_orderkey % 4) * 20 END AS sla FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    jobs = table(spark, sf, "orders").select(
        k,
        (F.col("o_totalprice") / 2000).alias("data_gb"),
        (F.col("o_custkey") % 6).alias("joins"),
        F.when(k % 4 != 3, (k % 4) * 20).alias("sla_minutes"),
    )
    return sc.job_sizing(jobs).drop("data_gb", "joins", "sla_minutes")


@query(
    "cost_columns",
    f"""WITH {CATALOG_SQL} SELECT table_name, count(*) AS column_count, greatest(5, count(*) // 2) AS estimated_runtime_minutes,
          count(*) * 0.5::DOUBLE AS estimated_scan_gb, round(greatest(5, count(*) // 2) * 0.25::DOUBLE, 2) AS estimated_cost_usd
        FROM catalog GROUP BY 1""",
)
def _(spark, sf):
    return sc.cost_columns(catalog(spark, sf))


@query(
    "partition_advice",
    f"""WITH {CATALOG_SQL}, r AS (SELECT table_name, min(CASE column_name WHEN 'event_date' THEN 0 WHEN 'ingestion_date' THEN 1
          WHEN 'created_at' THEN 2 END) AS r FROM catalog GROUP BY 1)
        SELECT table_name, CASE WHEN r IS NULL THEN 'none' ELSE 'date' END AS strategy,
               CASE r WHEN 0 THEN 'event_date' WHEN 1 THEN 'ingestion_date' WHEN 2 THEN 'created_at' END AS partition_column FROM r""",
)
def _(spark, sf):
    return sc.partition_advice(catalog(spark, sf))


@query(
    "join_advice",
    f"""WITH {CATALOG_SQL}, wide AS (
          SELECT 'wide_' || (p_partkey // 30) AS table_name, column_name FROM catalog UNION ALL SELECT table_name, column_name FROM catalog)
        SELECT table_name, CASE WHEN count(*) < 10 THEN 'broadcast' ELSE 'sort_merge' END AS join_strategy,
               count(*) < 10 AS broadcast_recommended, CASE WHEN count(*) > 20 THEN 400 ELSE 200 END AS shuffle_partitions,
               CASE WHEN bool_or(column_name IN ('id', 'customer_id')) THEN 'medium' ELSE 'low' END AS skew_risk
        FROM wide GROUP BY 1""",
)
def _(spark, sf):
    c = catalog(spark, sf)
    wide = c.select(F.expr("concat('wide_', p_partkey div 30)").alias("table_name"), "column_name")
    return sc.join_advice(wide.unionByName(c.select("table_name", "column_name")))
