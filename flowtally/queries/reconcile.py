"""Snapshots, manifests, artifacts, schemas and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.operators import graph
from flowtally.operators import reconcile as rec
from flowtally.operators.aggregates import is_blocking
from flowtally.queries.base import CATALOG_SQL, catalog, query, table
from flowtally.queries.records import FINDINGS_SQL, findings
from flowtally.scoring import spec_policy

# Files out of documents; each side leaves out and edits its own share
FILES_SQL = """
files AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'jobs' WHEN 1 THEN 'dags' ELSE 'other' END || '/d' || doc_id || '.txt' AS path,
                 sha256(text) AS sha256, length(text) AS size FROM documents),
base AS (SELECT path, sha256, size FROM files WHERE doc_id % 10 <> 0),
up AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'up' || sha256 ELSE sha256 END AS sha256,
              CASE WHEN doc_id % 2 = 0 THEN size END AS size FROM files WHERE doc_id % 11 <> 0),
ws AS (SELECT path, CASE WHEN doc_id % 14 = 0 THEN 'ws' || sha256 ELSE sha256 END AS sha256, size
       FROM files WHERE doc_id % 13 <> 0)
"""


def _side(spark, sf, skip: int, edit: int | None = None, mark: str = "") -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    folder = F.when(k % 3 == 0, "jobs").when(k % 3 == 1, "dags").otherwise("other")
    digest = F.sha2("text", 256)
    if edit:
        digest = F.when(k % edit == 0, F.concat(F.lit(mark), digest)).otherwise(digest)
    return d.where(k % skip != 0).select(
        F.concat(folder, F.lit("/d"), k, F.lit(".txt")).alias("path"),
        digest.alias("sha256"),
        F.length("text").cast("bigint").alias("size"),
    )


def _sides(spark, sf):
    return _side(spark, sf, 10), _side(spark, sf, 11, 7, "up"), _side(spark, sf, 13, 14, "ws")


DIFF_SQL = f"""
WITH {FILES_SQL}
SELECT coalesce(a.path, b.path) AS path,
       CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS status,
       a.sha256 AS sha256_a, b.sha256 AS sha256_b
FROM base a FULL JOIN up b ON a.path = b.path
WHERE a.sha256 IS DISTINCT FROM b.sha256
"""


@query("snapshot_diff", DIFF_SQL)
def _(spark, sf):
    base, up, _ = _sides(spark, sf)
    return rec.snapshot_diff(base, up, ["path"], ["sha256"])


@query(
    "snapshot_diff_rows",
    """SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'removed' WHEN p_partkey % 9 = 0 THEN 'added' ELSE 'changed' END AS status
       FROM part WHERE (p_partkey % 8 = 0) <> (p_partkey % 9 = 0)
          OR (p_partkey % 8 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 5 = 0)""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    a = p.where(k % 9 != 0)
    b = p.where(k % 8 != 0).withColumn("p_name", F.when(k % 5 != 0, F.col("p_name")))
    return rec.snapshot_diff(a, b, ["p_partkey"]).select("p_partkey", "status")


@query(
    "snapshot_diff_repeated_keys",
    """WITH a AS (SELECT l_orderkey AS k, list_sort(list(l_partkey)) AS v FROM lineitem GROUP BY 1),
            b AS (SELECT l_orderkey AS k, list_sort(list(l_partkey)) AS v FROM lineitem
                  WHERE l_linenumber <> 2 OR l_orderkey % 2 = 0 GROUP BY 1)
       SELECT a.k AS l_orderkey, CASE WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS status
       FROM a LEFT JOIN b ON a.k = b.k
       WHERE b.k IS NULL OR (a.v <> b.v AND NOT (len(list_distinct(a.v)) = 1 AND len(list_distinct(b.v)) = 1))""",
)
def _(spark, sf):
    """Orders have several lines each; one line less on a side is a change."""
    li = table(spark, sf, "lineitem")
    less = li.where((F.col("l_linenumber") != 2) | (F.col("l_orderkey") % 2 == 0))
    sides = [x.select("l_orderkey", F.col("l_partkey").cast("string").alias("sha256")) for x in (li, less)]
    return rec.snapshot_diff(*sides, ["l_orderkey"], ["sha256"]).select("l_orderkey", "status")


@query(
    "diff_summary",
    f"""WITH d AS ({DIFF_SQL})
        SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
               count(*) FILTER (status = 'changed') AS changed FROM d""",
)
def _(spark, sf):
    base, up, _ = _sides(spark, sf)
    return rec.diff_summary(rec.snapshot_diff(base, up, ["path"], ["sha256"]))


THREE_SQL = f"""
WITH {FILES_SQL}, keys AS (SELECT path FROM base UNION SELECT path FROM up UNION SELECT path FROM ws),
j AS (SELECT keys.path, base.sha256 AS b, up.sha256 AS u, ws.sha256 AS w FROM keys
      LEFT JOIN base USING (path) LEFT JOIN up USING (path) LEFT JOIN ws USING (path))
SELECT path, CASE WHEN starts_with(path, 'dags/') THEN 'dags' ELSE 'jobs' END AS scope,
       CASE WHEN u IS NULL THEN 'A' WHEN w IS NULL THEN 'D' ELSE 'M' END AS status,
       b AS baseline, u AS upstream, w AS workspace,
       CASE WHEN w IS NOT DISTINCT FROM b AND u IS DISTINCT FROM b THEN 'safe_auto' ELSE 'manual' END AS apply_mode,
       CASE WHEN w IS NOT DISTINCT FROM b AND u IS DISTINCT FROM b THEN 'workspace_clean_upstream_changed'
            ELSE 'requires_manual_review' END AS reason
FROM j WHERE u IS DISTINCT FROM w
"""


@query("three_way_reconcile", THREE_SQL)
def _(spark, sf):
    return rec.three_way_reconcile(*_sides(spark, sf))


@query(
    "sync_summary",
    f"""WITH t AS ({THREE_SQL})
        SELECT count(*) AS total_items, count(*) FILTER (apply_mode = 'safe_auto') AS safe_auto_items,
               count(*) FILTER (apply_mode <> 'safe_auto') AS manual_items FROM t""",
)
def _(spark, sf):
    return rec.sync_summary(rec.three_way_reconcile(*_sides(spark, sf)))


_TOPOLOGY = """CASE n_nationkey % 6 WHEN 0 THEN 'unrelated_histories' WHEN 1 THEN 'diverged' WHEN 2 THEN 'workspace_behind_linear'
  WHEN 3 THEN 'workspace_ahead_linear' WHEN 4 THEN 'equal' END"""


@query(
    "sync_summaries",
    f"""WITH t AS ({THREE_SQL}), s AS (SELECT n_nationkey AS sync, {_TOPOLOGY} AS topology FROM nation),
        c AS (SELECT length(path) AS sync, count(*) AS total_items, count(*) FILTER (apply_mode = 'safe_auto') AS safe_auto_items
              FROM t GROUP BY 1)
        SELECT sync, topology, coalesce(total_items, 0) AS total_items, coalesce(safe_auto_items, 0) AS safe_auto_items,
               coalesce(total_items - safe_auto_items, 0) AS manual_items,
               CASE topology WHEN 'unrelated_histories' THEN 'reset_or_rebaseline_required' WHEN 'diverged' THEN 'manual_resolution_required'
                 WHEN 'workspace_behind_linear' THEN 'safe_auto_apply_possible'
                 WHEN 'workspace_ahead_linear' THEN 'workspace_ahead_review_then_apply' ELSE 'manual_review' END AS recommended_action
        FROM s LEFT JOIN c USING (sync)""",
)
def _(spark, sf):
    """A sync per nation; paths belong to the sync of their length."""
    items = rec.three_way_reconcile(*_sides(spark, sf)).withColumn("sync", F.length("path"))
    syncs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("sync"), F.expr(_TOPOLOGY).alias("topology"))
    return rec.sync_summaries(items, syncs)


@query(
    "manifest_equal",
    f"""WITH {FILES_SQL}, c AS (SELECT path, sha256, CASE WHEN size % 2 = 0 THEN size END AS size FROM base)
        SELECT 'same' AS pair, bool_and(a.path IS NOT NULL AND c.path IS NOT NULL AND a.sha256 = c.sha256
                 AND (a.size IS NULL OR c.size IS NULL OR a.size = c.size)) AS equal
        FROM base a FULL JOIN c ON a.path = c.path
        UNION ALL
        SELECT 'other', bool_and(a.path IS NOT NULL AND u.path IS NOT NULL AND a.sha256 = u.sha256
                 AND (a.size IS NULL OR u.size IS NULL OR a.size = u.size))
        FROM base a FULL JOIN up u ON a.path = u.path""",
)
def _(spark, sf):
    base, up, _ = _sides(spark, sf)
    loose = base.withColumn("size", F.when(F.col("size") % 2 == 0, F.col("size")))
    same = rec.manifest_equal(base, loose).select(F.lit("same").alias("pair"), "equal")
    return same.unionByName(rec.manifest_equal(base, up).select(F.lit("other").alias("pair"), "equal"))


VERIFY_SQL = f"""
WITH {FILES_SQL}
SELECT coalesce(a.path, b.path) AS path,
       CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra'
            WHEN a.sha256 = b.sha256 THEN 'ok' ELSE 'mismatched' END AS status,
       CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN a.sha256 = b.sha256 END AS sha256_ok,
       a.sha256 AS expected_sha256, b.sha256 AS actual_sha256
FROM base a FULL JOIN ws b ON a.path = b.path
"""


@query("verify_hashes", VERIFY_SQL)
def _(spark, sf):
    base, _, ws = _sides(spark, sf)
    return rec.verify_hashes(base, ws)


@query(
    "verify_summary",
    f"""WITH v AS ({VERIFY_SQL})
        SELECT count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extras,
               count(*) FILTER (status = 'mismatched') AS mismatched,
               count(*) FILTER (status IN ('missing', 'mismatched')) = 0 AS ok FROM v""",
)
def _(spark, sf):
    base, _, ws = _sides(spark, sf)
    return rec.verify_summary(rec.verify_hashes(base, ws))


@query(
    "verify_releases",
    f"""WITH v AS ({VERIFY_SQL}),
        r AS (SELECT n_nationkey AS release, CASE WHEN n_nationkey % 5 <> 0 THEN sha256(n_name) END AS e,
                     CASE n_nationkey % 4 WHEN 1 THEN sha256('other') WHEN 3 THEN NULL ELSE sha256(n_name) END AS a FROM nation),
        c AS (SELECT length(path) AS release, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extras,
                     count(*) FILTER (status = 'mismatched') AS mismatched FROM v GROUP BY 1),
        j AS (SELECT release, coalesce(missing, 0) AS missing, coalesce(extras, 0) AS extras, coalesce(mismatched, 0) AS mismatched,
                     a IS NOT NULL AND (e IS NULL OR e = a) AS sha256_match,
                     coalesce(missing = 0 AND mismatched = 0, false) AS manifest_ok FROM r LEFT JOIN c USING (release))
        SELECT *, sha256_match AND manifest_ok AS ok FROM j""",
)
def _(spark, sf):
    """A release per nation; files belong to the release of their path's length."""
    base, _, ws = _sides(spark, sf)
    checks = rec.verify_hashes(base, ws).withColumn("release", F.length("path"))
    k, own = F.col("n_nationkey"), F.sha2("n_name", 256)
    releases = table(spark, sf, "nation").select(
        k.alias("release"),
        F.when(k % 5 != 0, own).alias("expected_sha256"),
        F.when(k % 4 == 1, F.sha2(F.lit("other"), 256)).when(k % 4 != 3, own).alias("actual_sha256"),
    )
    return rec.verify_releases(checks, releases)


@query(
    "artifact_integrity",
    f"""WITH {FILES_SQL}, j AS (
          SELECT files.path, up.sha256 AS act, ws.sha256 AS exp FROM files
          LEFT JOIN up USING (path) LEFT JOIN ws USING (path))
        SELECT path, act IS NOT NULL AND exp IS NOT NULL AND act = exp AS valid,
               CASE WHEN act IS NULL THEN 'artifact_missing' WHEN exp IS NULL THEN 'sha_file_missing' END AS reason,
               CASE WHEN act IS NOT NULL THEN exp END AS expected_sha, CASE WHEN exp IS NOT NULL THEN act END AS actual_sha
        FROM j""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, "jobs").when(k % 3 == 1, "dags").otherwise("other")
    expected = d.select(F.concat(folder, F.lit("/d"), k, F.lit(".txt")).alias("path"))
    _, up, ws = _sides(spark, sf)
    sums = ws.select("path", F.concat(F.lit(" "), "sha256", F.lit("  "), "path").alias("line"))
    return rec.artifact_integrity(expected, up, sums)


SCHEMA_SQL = f"""
WITH {CATALOG_SQL},
cur AS (SELECT * FROM catalog WHERE p_partkey % 6 <> 0),
new AS (SELECT table_name, column_name, CASE WHEN p_partkey % 7 = 0 THEN 'variant' ELSE data_type END AS data_type
        FROM catalog WHERE p_partkey % 8 <> 0)
SELECT coalesce(c.table_name, n.table_name) AS table_name, coalesce(c.column_name, n.column_name) AS column_name,
       CASE WHEN c.table_name IS NULL THEN 'added' WHEN n.table_name IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM cur c FULL JOIN new n ON c.table_name = n.table_name AND c.column_name = n.column_name
WHERE c.data_type IS DISTINCT FROM n.data_type
"""


def _schemas(spark, sf):
    c = catalog(spark, sf)
    kind = F.when(F.col("p_partkey") % 7 == 0, "variant").otherwise(F.col("data_type"))
    new = c.where("p_partkey % 8 <> 0").select("table_name", "column_name", kind.alias("data_type"))
    return c.where("p_partkey % 6 <> 0"), new


@query("schema_diff", SCHEMA_SQL)
def _(spark, sf):
    return rec.schema_diff(*_schemas(spark, sf))


@query(
    "schema_diff_summary",
    f"""WITH d AS ({SCHEMA_SQL})
        SELECT table_name, count(*) FILTER (change = 'added') AS added_columns,
               count(*) FILTER (change = 'changed') AS changed_columns,
               count(*) FILTER (change = 'removed') AS removed_columns, bool_or(change = 'changed') AS breaking_change
        FROM d GROUP BY 1""",
)
def _(spark, sf):
    return rec.schema_diff_summary(rec.schema_diff(*_schemas(spark, sf)))


_FINDING = "coalesce(code, 'advisor.finding') || ':' || substr(message, 1, 60)"


@query(
    "impact_nodes",
    f"""WITH {FINDINGS_SQL}, n AS (
          SELECT plan_id, seq, 'plan:' || plan_id AS id, 'plan' AS kind, plan_id AS key, job_name, NULL AS code,
                 NULL AS severity, NULL AS message FROM findings
          UNION ALL SELECT plan_id, seq, 'finding:' || {_FINDING}, 'finding', {_FINDING}, NULL,
                 coalesce(code, 'advisor.finding'), coalesce(severity, 'warn'), message FROM findings
          UNION ALL SELECT plan_id, seq, 'path:' || path, 'path', path, NULL, NULL, NULL, NULL FROM findings
          UNION ALL SELECT plan_id, seq, 'path:' || file, 'path', file, NULL, NULL, NULL, NULL FROM findings)
        SELECT plan_id, id, kind, key, job_name, code, severity, message FROM (
          SELECT *, row_number() OVER (PARTITION BY plan_id, id ORDER BY seq, severity) AS r FROM n) WHERE r = 1""",
)
def _(spark, sf):
    return graph.impact_nodes(findings(spark, sf))


@query(
    "impact_edges",
    f"""WITH {FINDINGS_SQL}
        SELECT plan_id, 'plan:' || plan_id AS "from", 'finding:' || {_FINDING} AS "to", 'has_finding' AS type FROM findings
        UNION ALL SELECT plan_id, 'finding:' || {_FINDING}, 'path:' || path, 'touches' FROM findings
        UNION ALL SELECT plan_id, 'finding:' || {_FINDING}, 'path:' || file, 'touches' FROM findings WHERE file <> path""",
)
def _(spark, sf):
    return graph.impact_edges(findings(spark, sf))


SPECS_SQL = """
specs AS (SELECT 'job_' || c_custkey AS job_name, CASE WHEN c_custkey % 4 <> 0 THEN 'o' || c_nationkey END AS owner,
                 CASE WHEN c_custkey % 6 = 0 THEN 'raw' ELSE 'raw.t' END AS source_table,
                 CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 15 = 1 THEN 'x' ELSE 'cur.t' END AS target_table
          FROM customer)
"""


def _specs(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("job_"), k).alias("job_name"),
        F.when(k % 4 != 0, F.concat(F.lit("o"), "c_nationkey")).alias("owner"),
        F.when(k % 6 == 0, "raw").otherwise("raw.t").alias("source_table"),
        F.when(k % 10 == 0, F.lit(None)).when(k % 15 == 1, "x").otherwise("cur.t").alias("target_table"),
    )


POLICY_SQL = f"""
WITH {SPECS_SQL}
SELECT job_name, 'WARN' AS status, 'OWNER_MISSING' AS code FROM specs WHERE owner IS NULL
UNION ALL
SELECT job_name, 'FAIL', CASE WHEN source_table NOT LIKE '%.%' THEN 'SOURCE_TABLE_INVALID' ELSE 'TARGET_TABLE_INVALID' END
FROM specs WHERE source_table NOT LIKE '%.%' OR target_table IS NULL OR target_table NOT LIKE '%.%'
"""


@query("spec_policy", POLICY_SQL)
def _(spark, sf):
    return spec_policy(_specs(spark, sf))


@query(
    "is_blocking",
    f"WITH p AS ({POLICY_SQL}) SELECT job_name, bool_or(status = 'FAIL') AS blocking FROM p GROUP BY 1",
)
def _(spark, sf):
    return is_blocking(spec_policy(_specs(spark, sf)))
