"""Ordered folds and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.operators.admission import budget_admission
from flowtally.operators.lifecycle import apply_commands, reconcile_stale_runs
from flowtally.operators.ratelimit import rate_limit
from flowtally.queries.base import BUDGETS_SQL, LEDGER_SQL, REQUESTS_SQL, budgets, day, ledger_log, query, requests, table
from flowtally.streaming import stream_audit_counts

# The newest event of a user is the user's run
RUNS_SQL = """
runs AS (SELECT 'r' || user_id AS run_id, max(ts) AS updated_ts,
                CASE arg_max(event_type, event_id) WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'CANCELING' WHEN 'purchase' THEN 'FAILED'
                     WHEN 'signup' THEN 'SUCCEEDED' ELSE 'PENDING' END AS status,
                arg_max(event_type, event_id) = 'click' AS cancel_requested
         FROM events GROUP BY user_id)
"""


def _runs(spark, sf) -> DataFrame:
    last = F.max_by("event_type", "event_id")
    runs = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("updated_ts"), last.alias("kind"))
    status = (
        F.when(F.col("kind") == "view", "RUNNING")
        .when(F.col("kind") == "click", "CANCELING")
        .when(F.col("kind") == "purchase", "FAILED")
        .when(F.col("kind") == "signup", "SUCCEEDED")
        .otherwise("PENDING")
    )
    return runs.select(
        F.concat(F.lit("r"), "user_id").alias("run_id"),
        status.alias("status"),
        F.col("updated_ts").alias("created_ts"),
        "updated_ts",
        (F.col("kind") == "click").alias("cancel_requested"),
        F.lit(None).cast("string").alias("terminal_reason"),
        F.lit(0).alias("retry_count"),
    )


@query(
    "reconcile_stale_runs",
    f"""WITH {RUNS_SQL}, s AS (SELECT *, status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED')
            AND updated_ts < TIMESTAMP '2024-01-31 00:00:00' - to_seconds(21600) AS stale FROM runs)
        SELECT run_id, CASE WHEN stale AND cancel_requested THEN 'CANCELED' WHEN stale THEN 'FAILED' ELSE status END AS status,
               CASE WHEN stale AND cancel_requested THEN 'stale_cancel_reconciled' WHEN stale THEN 'stale_run_reconciled' END AS terminal_reason,
               CASE WHEN stale THEN '2024-01-31 00:00:00' ELSE strftime(updated_ts, '%Y-%m-%d %H:%M:%S') END AS updated_at
        FROM s""",
)
def _(spark, sf):
    out = reconcile_stale_runs(_runs(spark, sf), "2024-01-31 00:00:00", 21600)
    return out.select("run_id", "status", "terminal_reason", day("updated_ts").alias("updated_at"))


@query(
    "apply_commands",
    """WITH RECURSIVE runs AS (
         SELECT 'r' || o_custkey AS run_id, CASE o_custkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'CANCELING'
                WHEN 3 THEN 'SUCCEEDED' WHEN 4 THEN 'FAILED' ELSE 'CANCELED' END AS status FROM orders GROUP BY o_custkey),
       cmd AS (SELECT 'r' || o_custkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'cancel' ELSE 'retry' END AS command,
                      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
       f(run_id, status, asked, retries, errors, n) AS (
         SELECT run_id, status, FALSE, 0, 0, 0 FROM runs
         UNION ALL
         SELECT f.run_id,
                CASE WHEN command = 'cancel' AND status IN ('PENDING', 'RUNNING', 'CANCELING') THEN 'CANCELING'
                     WHEN command = 'retry' AND status IN ('FAILED', 'CANCELED') THEN 'PENDING' ELSE status END,
                CASE WHEN command = 'cancel' AND status IN ('PENDING', 'RUNNING', 'CANCELING') THEN TRUE
                     WHEN command = 'retry' AND status IN ('FAILED', 'CANCELED') THEN FALSE ELSE asked END,
                retries + CASE WHEN command = 'retry' AND status IN ('FAILED', 'CANCELED') THEN 1 ELSE 0 END,
                errors + CASE WHEN command = 'retry' AND status = 'SUCCEEDED' THEN 1 ELSE 0 END,
                cmd.n
         FROM f JOIN cmd ON cmd.run_id = f.run_id AND cmd.n = f.n + 1)
       SELECT run_id, arg_max(status, n) AS status, arg_max(asked, n) AS cancel_requested,
              arg_max(retries, n) AS retry_count, arg_max(errors, n) AS errors FROM f GROUP BY 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    run = F.concat(F.lit("r"), "o_custkey").alias("run_id")
    k = F.col("o_custkey") % 6
    status = (
        F.when(k == 0, "PENDING")
        .when(k == 1, "RUNNING")
        .when(k == 2, "CANCELING")
        .when(k == 3, "SUCCEEDED")
        .when(k == 4, "FAILED")
        .otherwise("CANCELED")
    )
    runs = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_ts")).select(
        run,
        status.alias("status"),
        "created_ts",
        F.col("created_ts").alias("updated_ts"),
        F.lit(False).alias("cancel_requested"),
        F.lit(None).cast("string").alias("terminal_reason"),
        F.lit(0).alias("retry_count"),
    )
    commands = o.select(
        run,
        F.when(F.col("o_orderkey") % 3 == 0, "cancel").otherwise("retry").alias("command"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("ts"),
    )
    out = apply_commands(runs, commands)
    return out.select("run_id", "status", "cancel_requested", "retry_count", "errors")


@query(
    "rate_limit",
    """WITH RECURSIVE e AS (
         SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
         FROM events WHERE event_type <> 'view' AND event_type <> 'signup'),
       f(user_id, event_id, t, n, start, cnt) AS (
         SELECT user_id, event_id, t, n, t, 1 FROM e WHERE n = 1
         UNION ALL
         SELECT e.user_id, e.event_id, e.t, e.n, CASE WHEN e.t - f.start >= 172800000000 THEN e.t ELSE f.start END,
                CASE WHEN e.t - f.start >= 172800000000 THEN 1 ELSE cnt + 1 END
         FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
       SELECT event_id, strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S') AS window_start,
              CAST(cnt AS BIGINT) AS window_count, cnt > 3 AS over_limit FROM f""",
)
def _(spark, sf):
    out = rate_limit(requests(spark, sf), "user_id", "ts", ["event_id"], rpm=3, method="method", window_seconds=172_800)
    return out.select("event_id", day("window_start").alias("window_start"), "window_count", "over_limit")


@query(
    "rate_limit_hot_key",
    """WITH RECURSIVE e AS (
         SELECT k, event_id, t, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS n
         FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id END AS k, event_id, epoch_us(ts) AS t FROM events)),
       f(k, event_id, t, n, start, cnt) AS (
         SELECT k, event_id, t, n, t, 1 FROM e WHERE n = 1
         UNION ALL
         SELECT e.k, e.event_id, e.t, e.n, CASE WHEN e.t - f.start >= 7200000000 THEN e.t ELSE f.start END,
                CASE WHEN e.t - f.start >= 7200000000 THEN 1 ELSE cnt + 1 END
         FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)
       SELECT event_id, strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S') AS window_start,
              CAST(cnt AS BIGINT) AS window_count, cnt > 8 AS over_limit FROM f""",
)
def _(spark, sf):
    key = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "user_id"))
    e = table(spark, sf, "events").select("event_id", "ts", key.alias("k"))
    # low bounds, so that the chunked path runs at every scale
    out = rate_limit(e, "k", "ts", ["event_id"], rpm=8, window_seconds=7200, min_rows=100, parts=40)
    return out.select("event_id", day("window_start").alias("window_start"), "window_count", "over_limit")


ADMISSION_SQL = f"""
WITH RECURSIVE {LEDGER_SQL}, {BUDGETS_SQL},
req AS (
  SELECT seq, tenant, month, entry_id, CAST(round(estimated_cost_usd * 1000000) AS BIGINT) AS c,
         CAST(round(coalesce(limit_usd, 250.0::DOUBLE) * 100000) AS BIGINT) AS lim,
         row_number() OVER (PARTITION BY tenant, month ORDER BY seq) AS n
  FROM ledger_log LEFT JOIN budgets USING (tenant)),
f(tenant, month, seq, n, spent, est, decision) AS (
  SELECT tenant, month, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), MAP {{'': CAST(0 AS BIGINT)}}, ''
  FROM req WHERE n = 1
  UNION ALL
  SELECT tenant, month, seq, n, CASE WHEN d = 'BLOCK' THEN spent ELSE spent + c - coalesce(est[entry_id], 0) END,
         CASE WHEN d = 'BLOCK' THEN est ELSE map_concat(est, MAP {{entry_id: c}}) END, d
  FROM (SELECT r.tenant, r.month, r.seq, r.n, r.c, r.entry_id, f.spent, f.est,
               CASE WHEN f.spent >= r.lim OR f.spent + r.c > r.lim THEN 'BLOCK'
                    WHEN r.lim > 0 AND (f.spent + r.c) / r.lim >= 0.8 THEN 'WARN' ELSE 'ALLOW' END AS d
        FROM f JOIN req r ON r.tenant = f.tenant AND r.month = f.month AND r.n = f.n + 1))
SELECT seq, decision FROM f WHERE n > 0
"""


@query("budget_admission", ADMISSION_SQL)
def _(spark, sf):
    limits = budgets(spark, sf).withColumn("limit_usd", F.col("limit_usd") / 10)
    log = ledger_log(spark, sf).select("seq", "tenant", "month", "entry_id", "estimated_cost_usd")
    return budget_admission(log, limits, default_limit=25.0).select("seq", "decision")


@query(
    "audit_counts_by_hour",
    f"""WITH {REQUESTS_SQL}
        SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, upper(coalesce(method, 'UNKNOWN')) AS method,
               path, coalesce(CAST(status AS VARCHAR), 'unknown') AS status, count(*) AS requests
        FROM requests GROUP BY ALL""",
)
def _(spark, sf):
    log = requests(spark, sf).select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.struct("method", "path", "status").alias("http")
    )
    return stream_audit_counts(log, "1 hour").withColumn("window_start", day("window_start"))
