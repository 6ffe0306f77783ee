"""Ledger, audit, builds, counters, ordering and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.operators import aggregates as agg
from flowtally.operators import ordered, sets
from flowtally.operators.filters import audit_filter, for_tenant_month
from flowtally.operators.lookups import with_budget
from flowtally.queries.base import (
    BUDGETS_SQL,
    LEDGER_SQL,
    REQUESTS_SQL,
    budgets,
    day,
    ledger_log,
    query,
    requests,
    table,
)

_R = 6


def _money(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on the order of addition in the last digits."""
    return df.withColumns({n: F.round(n, _R) for n in names})


@query(
    "for_tenant_month",
    f"WITH {LEDGER_SQL} SELECT seq, entry_id FROM ledger_log WHERE tenant = 't1' AND month = '1997-05'",
)
def _(spark, sf):
    return for_tenant_month(ledger_log(spark, sf), "t1", "1997-05").select("seq", "entry_id")


@query(
    "spend_estimated",
    f"""WITH {LEDGER_SQL} SELECT tenant, month, round(sum(estimated_cost_usd), 6) AS spent_estimated_usd
        FROM ledger_log GROUP BY 1, 2""",
)
def _(spark, sf):
    return _money(agg.spend_estimated(ledger_log(spark, sf)), "spent_estimated_usd")


@query(
    "spend_actual",
    f"""WITH {LEDGER_SQL} SELECT tenant, month, round(coalesce(sum(actual_cost_usd), 0), 6) AS spent_actual_usd
        FROM ledger_log GROUP BY 1, 2""",
)
def _(spark, sf):
    return _money(agg.spend_actual(ledger_log(spark, sf)), "spent_actual_usd")


@query(
    "spend_breakdown",
    f"""WITH {LEDGER_SQL} SELECT tenant, month,
          round(coalesce(sum(actual_cost_usd) FILTER (starts_with(job_name, 'ai_')), 0), 6) AS ai_actual_usd,
          round(coalesce(sum(actual_cost_usd) FILTER (NOT starts_with(job_name, 'ai_')), 0), 6) AS non_ai_actual_usd,
          round(coalesce(sum(actual_cost_usd), 0), 6) AS total_actual_usd
        FROM ledger_log GROUP BY 1, 2""",
)
def _(spark, sf):
    out = agg.spend_breakdown(ledger_log(spark, sf))
    return _money(out, "ai_actual_usd", "non_ai_actual_usd", "total_actual_usd")


@query(
    "spend_by_ai_task",
    f"""WITH {LEDGER_SQL} SELECT tenant, month, job_name, round(sum(actual_cost_usd), 6) AS ai_task_usd
        FROM ledger_log WHERE starts_with(job_name, 'ai_') AND actual_cost_usd IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return agg.spend_by_ai_task(ledger_log(spark, sf))


@query(
    "entries_count",
    f"WITH {LEDGER_SQL} SELECT tenant, month, count(*) AS entries_count FROM ledger_log GROUP BY 1, 2",
)
def _(spark, sf):
    return agg.entries_count(ledger_log(spark, sf))


@query(
    "with_budget",
    f"""WITH {LEDGER_SQL}, {BUDGETS_SQL}
        SELECT seq, tenant, coalesce(limit_usd, 250.0::DOUBLE) AS limit_usd
        FROM ledger_log LEFT JOIN budgets USING (tenant)""",
)
def _(spark, sf):
    return with_budget(ledger_log(spark, sf).select("seq", "tenant"), budgets(spark, sf))


SUMMARY_SQL = f"""
WITH {LEDGER_SQL}, {BUDGETS_SQL},
live AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS n FROM ledger_log) WHERE n = 1),
spent AS (
  SELECT tenant, month, coalesce(limit_usd, 250.0::DOUBLE) AS limit_usd, sum(estimated_cost_usd) AS est,
         coalesce(sum(actual_cost_usd), 0) AS act,
         coalesce(sum(actual_cost_usd) FILTER (starts_with(job_name, 'ai_')), 0) AS ai,
         coalesce(sum(actual_cost_usd) FILTER (NOT starts_with(job_name, 'ai_')), 0) AS other,
         count(*) AS entries_count
  FROM live LEFT JOIN budgets USING (tenant) GROUP BY 1, 2, 3)
SELECT tenant, month, limit_usd, round(est, 6) AS spent_estimated_usd, round(act, 6) AS spent_actual_usd,
       round(ai, 6) AS ai_spent_actual_usd, round(other, 6) AS non_ai_spent_actual_usd, entries_count,
       round(greatest(0, limit_usd - est), 6) AS remaining_estimated_usd,
       round(CASE WHEN limit_usd <= 0 THEN 0 ELSE least(1, est / limit_usd) END, 6) AS utilization_estimated,
       CASE WHEN limit_usd > 0 AND est >= limit_usd THEN 'exceeded'
            WHEN limit_usd > 0 AND est / limit_usd >= 0.8 THEN 'warning' ELSE 'ok' END AS budget_status
FROM spent
"""


@query("billing_summary", SUMMARY_SQL)
def _(spark, sf):
    live = ordered.latest_per_key(ledger_log(spark, sf), ["entry_id"], ["seq"])
    out = agg.billing_summary(live, budgets(spark, sf)).drop("projected_spent_usd", "projected_utilization")
    money = [c for c in out.columns if c.endswith("_usd") and c != "limit_usd"]
    return _money(out, *money, "utilization_estimated")


@query(
    "latest_per_key",
    f"""WITH {LEDGER_SQL} SELECT entry_id, max(seq) AS seq, arg_max(job_name, seq) AS job_name,
          arg_max(estimated_cost_usd, seq) AS estimated_cost_usd FROM ledger_log GROUP BY 1""",
)
def _(spark, sf):
    out = ordered.latest_per_key(ledger_log(spark, sf), ["entry_id"], ["seq"])
    return out.select("entry_id", "seq", "job_name", "estimated_cost_usd")


@query(
    "coalesce_patches",
    f"""WITH {LEDGER_SQL},
    est AS (SELECT * FROM ledger_log WHERE seq % 3 <> 2),
    act AS (SELECT seq, entry_id, job_name, actual_cost_usd,
              CASE WHEN seq % 2 = 0 THEN seq * 1.0::DOUBLE END AS runtime FROM ledger_log WHERE seq % 3 = 2),
    last_est AS (SELECT entry_id, max(seq) AS at, arg_max(job_name, seq) AS job_name,
                        arg_max(estimated_cost_usd, seq) AS cost FROM est GROUP BY 1),
    first_act AS (SELECT entry_id, arg_min(job_name, seq) AS job_name FROM act GROUP BY 1),
    live AS (SELECT act.* FROM act LEFT JOIN last_est USING (entry_id)
             WHERE last_est.at IS NULL OR act.seq > last_est.at),
    folded AS (SELECT entry_id, arg_max(actual_cost_usd, seq) FILTER (actual_cost_usd IS NOT NULL) AS cost,
                      arg_max(runtime, seq) FILTER (runtime IS NOT NULL) AS runtime FROM live GROUP BY 1)
    SELECT entry_id, coalesce(e.job_name, f.job_name) AS job_name, coalesce(e.cost, 0.0) AS estimated_cost_usd,
           p.cost AS actual_cost_usd, p.runtime AS actual_runtime_seconds
    FROM last_est e FULL JOIN first_act f USING (entry_id) LEFT JOIN folded p USING (entry_id)""",
)
def _(spark, sf):
    log = ledger_log(spark, sf)
    est = log.where("seq % 3 <> 2").select("entry_id", "seq", "job_name", "estimated_cost_usd")
    act = log.where("seq % 3 = 2").select(
        "entry_id",
        "seq",
        "job_name",
        "actual_cost_usd",
        F.when(F.col("seq") % 2 == 0, F.col("seq").cast("double")).alias("actual_runtime_seconds"),
    )
    return ordered.coalesce_patches(est, act, fields=("actual_cost_usd", "actual_runtime_seconds"))


# Build log out of events: a job per user, a new specification now and then
BUILDS_SQL = """
builds AS (SELECT 'job_' || user_id AS job_name, event_id AS seq, ts,
                  CASE WHEN event_id % 17 <> 0 THEN sha256(event_type) END AS spec_hash, event_type FROM events)
"""


def _builds(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("job_"), "user_id").alias("job_name"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(F.col("event_id") % 17 != 0, F.sha2("event_type", 256)).alias("spec_hash"),
        "event_type",
    )


@query(
    "current_build",
    f"WITH {BUILDS_SQL} SELECT job_name, max(seq) AS seq, arg_max(event_type, seq) AS event_type FROM builds GROUP BY 1",
)
def _(spark, sf):
    return ordered.current_build(_builds(spark, sf)).select("job_name", "seq", "event_type")


@query(
    "needs_rebuild",
    f"""WITH {BUILDS_SQL}
    SELECT job_name, seq, lag(seq) OVER w IS NULL OR spec_hash IS DISTINCT FROM lag(spec_hash) OVER w AS rebuild
    FROM builds WINDOW w AS (PARTITION BY job_name ORDER BY seq)""",
)
def _(spark, sf):
    return ordered.needs_rebuild(_builds(spark, sf)).select("job_name", "seq", "rebuild")


_STATE = """CASE (event_id // 3) % 7 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'PLAN_READY' WHEN 2 THEN 'PRECHECK_PASSED'
       WHEN 3 THEN 'APPLIED' WHEN 4 THEN 'RUNNING' WHEN 5 THEN 'SUCCEEDED' ELSE 'BLOCKED' END"""


@query(
    "check_transitions",
    f"""WITH s AS (SELECT 'exec_' || (event_id // 20) AS job_name, event_id AS seq, {_STATE} AS state FROM events),
    p AS (SELECT *, lag(state) OVER (PARTITION BY job_name ORDER BY seq) AS previous_state FROM s)
    SELECT job_name, seq, state, previous_state,
      previous_state IS NULL OR previous_state = state OR (
        previous_state NOT IN ('SUCCEEDED', 'FAILED', 'BLOCKED', 'CANCELED') AND (previous_state, state) IN (
          ('DRAFT', 'PLAN_READY'), ('PLAN_READY', 'PRECHECK_PASSED'), ('PRECHECK_PASSED', 'APPLIED'),
          ('APPLIED', 'RUNNING'), ('APPLIED', 'CANCELED'), ('RUNNING', 'CANCELED'), ('RUNNING', 'SUCCEEDED'),
          ('RUNNING', 'FAILED'), ('PRECHECK_PASSED', 'BLOCKED'), ('PLAN_READY', 'BLOCKED'), ('DRAFT', 'BLOCKED'))) AS legal
    FROM p""",
)
def _(spark, sf):
    s = table(spark, sf, "events").select(
        F.expr("concat('exec_', event_id div 20)").alias("job_name"),
        F.col("event_id").alias("seq"),
        F.expr(_STATE.replace("//", "div")).alias("state"),
    )
    return ordered.check_transitions(s, order=["seq"])


@query(
    "execution_actuals",
    """SELECT o_orderkey, strftime(finished_ts, '%Y-%m') AS month,
         greatest(0, date_diff('second', o_orderdate, finished_ts)) * 1.0::DOUBLE AS actual_runtime_seconds,
         o_totalprice AS actual_cost_usd
       FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN
               o_orderdate + to_minutes(CAST(o_orderkey % 5000 AS BIGINT)) - to_minutes(2000) END AS finished_ts FROM orders)
       WHERE finished_ts IS NOT NULL""",
)
def _(spark, sf):
    done = F.expr("o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 5000 - 2000 AS INT))")
    records = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").alias("submitted_ts"),
        F.when(F.col("o_orderstatus") == "F", done).alias("finished_ts"),
        F.col("o_totalprice").alias("estimated_cost_usd"),
    )
    out = ordered.execution_actuals(records)
    return out.select("o_orderkey", "month", "actual_runtime_seconds", "actual_cost_usd")


@query(
    "execution_history",
    f"""WITH {BUILDS_SQL}
    SELECT job_name, seq, row_number() OVER (PARTITION BY job_name ORDER BY ts, seq) AS position FROM builds""",
)
def _(spark, sf):
    return ordered.execution_history(_builds(spark, sf)).select("job_name", "seq", "position")


# The same log with one job that has most of the builds, all of a month at one time
HOT_BUILDS_SQL = """
builds AS (SELECT CASE WHEN event_id % 10 < 7 THEN 'job_hot' ELSE 'job_' || user_id END AS job_name, event_id AS seq,
                  date_trunc('month', ts) AS ts, CASE WHEN event_id % 17 <> 0 THEN sha256(event_type) END AS spec_hash,
                  CASE event_type WHEN 'click' THEN 'DRAFT' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'APPLIED'
                    WHEN 'signup' THEN 'PLAN_READY' ELSE 'RUNNING' END AS state
           FROM events)
"""
# most rows of a job in one group, so that the hot job is cut at any scale
HOT_CHUNK = 500


def _hot_builds(spark, sf) -> DataFrame:
    states = F.expr(
        "CASE event_type WHEN 'click' THEN 'DRAFT' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'APPLIED' "
        "WHEN 'signup' THEN 'PLAN_READY' ELSE 'RUNNING' END"
    )
    return table(spark, sf, "events").select(
        F.when(F.col("event_id") % 10 < 7, F.lit("job_hot")).otherwise(F.concat(F.lit("job_"), "user_id")).alias("job_name"),
        F.col("event_id").alias("seq"),
        F.date_trunc("month", "ts").alias("ts"),
        F.when(F.col("event_id") % 17 != 0, F.sha2("event_type", 256)).alias("spec_hash"),
        states.alias("state"),
    )


@query(
    "needs_rebuild_hot_key",
    f"""WITH {HOT_BUILDS_SQL}
    SELECT job_name, seq, lag(seq) OVER w IS NULL OR spec_hash IS DISTINCT FROM lag(spec_hash) OVER w AS rebuild
    FROM builds WINDOW w AS (PARTITION BY job_name ORDER BY ts, seq)""",
)
def _(spark, sf):
    out = ordered.needs_rebuild(_hot_builds(spark, sf), order=["ts", "seq"], chunk_rows=HOT_CHUNK)
    return out.select("job_name", "seq", "rebuild")


@query(
    "check_transitions_hot_key",
    f"""WITH {HOT_BUILDS_SQL},
    p AS (SELECT job_name, seq, state, lag(state) OVER (PARTITION BY job_name ORDER BY ts, seq) AS previous_state FROM builds)
    SELECT *, previous_state IS NULL OR previous_state = state OR (previous_state <> 'FAILED' AND (previous_state, state) IN (
      ('DRAFT', 'PLAN_READY'), ('APPLIED', 'RUNNING'), ('RUNNING', 'FAILED'))) AS legal FROM p""",
)
def _(spark, sf):
    out = ordered.check_transitions(_hot_builds(spark, sf), chunk_rows=HOT_CHUNK)
    return out.select("job_name", "seq", "state", "previous_state", "legal")


@query(
    "execution_history_hot_key",
    f"""WITH {HOT_BUILDS_SQL}
    SELECT job_name, seq, row_number() OVER (PARTITION BY job_name ORDER BY ts, seq) AS position FROM builds""",
)
def _(spark, sf):
    return ordered.execution_history(_hot_builds(spark, sf), chunk_rows=HOT_CHUNK).select("job_name", "seq", "position")


@query(
    "newest_first",
    f"WITH {BUILDS_SQL} SELECT seq, job_name FROM builds ORDER BY seq DESC",
)
def _(spark, sf):
    return ordered.newest_first(_builds(spark, sf)).select("seq", "job_name")


@query(
    "tail_events",
    f"""WITH {BUILDS_SQL} SELECT seq, job_name FROM (SELECT * FROM builds ORDER BY seq DESC LIMIT 500)
        WHERE spec_hash IS NOT NULL ORDER BY seq""",
)
def _(spark, sf):
    out = ordered.tail_events(_builds(spark, sf), 500, keep=F.col("spec_hash").isNotNull())
    return out.select("seq", "job_name")


@query(
    "top_k_per_group",
    """SELECT o_custkey, o_orderkey FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
       WHERE n <= 3""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    out = ordered.top_k_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3)
    return out.select("o_custkey", "o_orderkey")


@query(
    "audit_filter",
    """SELECT event_id FROM events
       WHERE ('team_' || (user_id % 7)) LIKE '%m_3%' AND lower('User' || user_id) LIKE '%er1%'
         AND event_type LIKE '%ic%'""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("Team_"), F.col("user_id") % 7).alias("tenant"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("User"), "user_id")).alias("actor"),
        F.concat(F.lit("USER"), "user_id").alias("user"),
        F.col("event_type").alias("type"),
    )
    return audit_filter(e, "M_3", "er1", "IC").select("event_id")


@query(
    "request_counters",
    f"""WITH {REQUESTS_SQL}, r AS (
          SELECT upper(coalesce(method, 'UNKNOWN')) AS method, path,
                 coalesce(CAST(status AS VARCHAR), 'unknown') AS status FROM requests)
        SELECT 'total' AS counter, NULL AS method, NULL AS path, NULL AS status, count(*) AS requests FROM r
        UNION ALL SELECT 'method', method, NULL, NULL, count(*) FROM r GROUP BY method
        UNION ALL SELECT 'path', NULL, path, NULL, count(*) FROM r GROUP BY path
        UNION ALL SELECT 'path_status', NULL, path, status, count(*) FROM r GROUP BY path, status
        UNION ALL SELECT 'method_path_status', method, path, status, count(*) FROM r GROUP BY method, path, status""",
)
def _(spark, sf):
    return agg.request_counters(requests(spark, sf)).select("counter", "method", "path", "status", "requests")


@query(
    "named_counters",
    """SELECT event_type AS name, CAST(sum(event_id % 4) AS BIGINT) AS total FROM events
       WHERE user_id % 10 <> 0 GROUP BY 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("event_type")).alias("name"),
        (F.col("event_id") % 4).alias("step"),
    )
    return agg.named_counters(e, "name", "step")


@query(
    "histogram_counts",
    f"""WITH {REQUESTS_SQL}
        SELECT method, path, count(*) FILTER (value <= 5) AS le_5, count(*) FILTER (value <= 12.5) AS le_12_5,
               count(*) FILTER (value <= 50) AS le_50, count(value) AS le_inf, round(sum(value), 6) AS value_sum,
               count(value) AS value_count
        FROM requests GROUP BY 1, 2""",
)
def _(spark, sf):
    return _money(agg.histogram_counts(requests(spark, sf), "value", [5, 12.5, 50]), "value_sum")


# Findings out of line items: one plan per order
FINDINGS_SQL = """
findings AS (
  SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq, 'p' || l_orderkey AS plan_id,
         'job_' || (l_orderkey % 50) AS job_name,
         CASE WHEN l_linenumber <> 5 THEN 'code.' || (l_partkey % 5) END AS code,
         CASE l_suppkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' WHEN 2 THEN 'block' END AS severity,
         'finding number ' || l_linenumber || ' with a long text that is cut after sixty characters, part ' || l_partkey AS message,
         'src/' || l_suppkey || '.py' AS path, 'src/' || (l_partkey % 100) || '.py' AS file
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem))
"""


def findings(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").distinct()
    supp = F.col("l_suppkey") % 4
    return li.select(
        F.expr("l_orderkey * 1000000 + l_partkey * 10 + l_linenumber").alias("seq"),
        F.concat(F.lit("p"), "l_orderkey").alias("plan_id"),
        F.concat(F.lit("job_"), F.col("l_orderkey") % 50).alias("job_name"),
        F.when(F.col("l_linenumber") != 5, F.concat(F.lit("code."), F.col("l_partkey") % 5)).alias("code"),
        F.when(supp == 0, "info").when(supp == 1, "warn").when(supp == 2, "block").alias("severity"),
        F.concat(
            F.lit("finding number "),
            "l_linenumber",
            F.lit(" with a long text that is cut after sixty characters, part "),
            "l_partkey",
        ).alias("message"),
        F.concat(F.lit("src/"), "l_suppkey", F.lit(".py")).alias("path"),
        F.concat(F.lit("src/"), F.col("l_partkey") % 100, F.lit(".py")).alias("file"),
    )


@query(
    "max_severity",
    f"""WITH {FINDINGS_SQL}, r AS (
          SELECT plan_id, max(CASE severity WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS r FROM findings GROUP BY 1)
        SELECT plan_id, CASE r WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'info' END AS max_severity,
               CASE r WHEN 2 THEN 'FAIL' ELSE 'PASS' END AS status FROM r""",
)
def _(spark, sf):
    return agg.max_severity(findings(spark, sf), ["plan_id"])


@query(
    "finding_counts",
    f"WITH {FINDINGS_SQL} SELECT plan_id, count(*) AS finding_count FROM findings GROUP BY 1",
)
def _(spark, sf):
    return agg.finding_counts(findings(spark, sf))


@query(
    "keys_added",
    """SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN
         (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").where("c_custkey % 3 = 0")
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sets.keys_added(a, b, ["c_custkey"])


@query(
    "keys_removed",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)",
)
def _(spark, sf):
    b = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return sets.keys_removed(table(spark, sf, "customer"), b, ["c_custkey"])


@query(
    "keys_common",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)",
)
def _(spark, sf):
    b = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return sets.keys_common(table(spark, sf, "customer"), b, ["c_custkey"])


@query(
    "union_events",
    """SELECT event_id AS id, event_type AS kind, NULL AS amount FROM events
       UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("amount")
    )
    return sets.union_events(e, o)


@query(
    "distinct_paths",
    f"WITH {REQUESTS_SQL} SELECT DISTINCT path FROM requests ORDER BY path",
)
def _(spark, sf):
    return sets.distinct_paths(requests(spark, sf))
