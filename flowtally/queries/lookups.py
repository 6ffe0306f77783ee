"""Prices, approvals, lineage, path areas and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.operators import lookups
from flowtally.operators.search import text_search
from flowtally.queries.base import query, table

PRICES_SQL = """
prices AS (SELECT * FROM (VALUES
  ('aws', 'us-east-1', 0.045::DOUBLE), ('aws', 'eu-west-1', 0.052), ('gcp', 'us-central1', 0.044),
  ('gcp', 'europe-west1', 0.050), ('azure', 'eastus', 0.047), ('azure', 'westeurope', 0.053),
  ('k8s', 'default', 0.040)) v(provider, region, price)),
overrides AS (
  SELECT CASE n_nationkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END AS provider,
         CASE n_nationkey % 4 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'default' ELSE n_name END AS region,
         max(n_nationkey / 1000.0::DOUBLE) AS price
  FROM nation GROUP BY 1, 2),
book AS (SELECT coalesce(o.provider, p.provider) AS provider, coalesce(o.region, p.region) AS region,
                coalesce(o.price, p.price) AS price
         FROM prices p FULL JOIN overrides o ON p.provider = o.provider AND p.region = o.region)
"""

# Runtimes are odd on purpose: the engines round exact halves differently
CLOUD_JOBS_SQL = """
jobs AS (
  SELECT c_custkey,
         CASE c_custkey % 5 WHEN 0 THEN 'AWS' WHEN 1 THEN 'gcp' WHEN 2 THEN 'azure' WHEN 3 THEN 'k8s' ELSE 'other' END AS provider,
         CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'us-east-1' WHEN 2 THEN 'europe-west1' WHEN 3 THEN 'eastus'
              WHEN 4 THEN 'default' ELSE 'NATION_2' END AS region,
         CASE WHEN c_custkey % 3 = 0 THEN 'm5' END AS instance_type,
         c_custkey % 9 AS executors, (c_custkey % 4) * 1.0::DOUBLE AS vcpu_per_executor,
         c_custkey % 2 = 0 AS spot, abs(c_acctbal) / 10 + 0.01371::DOUBLE AS runtime_minutes
  FROM customer)
"""


def overrides(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    provider = F.when(k % 3 == 0, "aws").when(k % 3 == 1, "gcp").otherwise("azure")
    region = F.when(k % 4 == 0, "us-east-1").when(k % 4 == 1, "default").otherwise(F.col("n_name"))
    return n.select(provider.alias("provider"), region.alias("region"), (k / 1000.0).alias("price"))


def cloud_jobs(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        """CASE c_custkey % 5 WHEN 0 THEN 'AWS' WHEN 1 THEN 'gcp' WHEN 2 THEN 'azure' WHEN 3 THEN 'k8s'
           ELSE 'other' END AS provider""",
        """CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'us-east-1' WHEN 2 THEN 'europe-west1' WHEN 3 THEN 'eastus'
           WHEN 4 THEN 'default' ELSE 'NATION_2' END AS region""",
        "CASE WHEN c_custkey % 3 = 0 THEN 'm5' END AS instance_type",
        "c_custkey % 9 AS executors",
        "CAST(c_custkey % 4 AS DOUBLE) AS vcpu_per_executor",
        "c_custkey % 2 = 0 AS spot",
        "abs(c_acctbal) / 10 + 0.01371D AS runtime_minutes",
    )


@query(
    "with_price",
    f"""WITH {PRICES_SQL}, {CLOUD_JOBS_SQL}, j AS (
          SELECT *, lower(provider) AS p, coalesce(region, CASE WHEN lower(provider) = 'k8s' THEN 'default' ELSE 'us-east-1' END) AS used
          FROM jobs)
        SELECT j.c_custkey, j.used AS region_used, coalesce(a.price, b.price, 0.05) AS vcpu_hour_usd
        FROM j LEFT JOIN book a ON a.provider = j.p AND a.region = j.used
               LEFT JOIN book b ON b.provider = j.p AND b.region = 'default'""",
)
def _(spark, sf):
    out = lookups.with_price(cloud_jobs(spark, sf), overrides(spark, sf))
    return out.select("c_custkey", "region_used", "vcpu_hour_usd")


@query(
    "valid_approval",
    """WITH req AS (SELECT o_orderkey, 'j' || o_custkey AS job_name, 'h' || (o_orderkey % 3) AS plan_hash,
                           o_orderdate + to_hours(2000) AS at FROM orders),
    app AS (SELECT 'j' || o_custkey AS job_name, 'h' || (o_orderkey % 3) AS plan_hash, 'a' || o_orderkey AS approver,
                   o_orderdate AS approved, o_orderkey % 10 = 0 AS odd, o_orderkey AS seq
            FROM orders WHERE o_orderkey % 2 = 0),
    lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_name, plan_hash ORDER BY seq DESC) AS n FROM app)
            WHERE n = 1)
    SELECT o_orderkey, l.seq IS NOT NULL AND (l.odd OR req.at - l.approved <= to_hours(8000)) AS approved,
           CASE WHEN l.seq IS NOT NULL AND (l.odd OR req.at - l.approved <= to_hours(8000)) THEN l.approver END AS approver
    FROM req LEFT JOIN lst l USING (job_name, plan_hash)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    job, plan = F.concat(F.lit("j"), "o_custkey").alias("job_name"), F.concat(F.lit("h"), F.col("o_orderkey") % 3)
    req = o.select("o_orderkey", job, plan.alias("plan_hash"), F.expr("o_orderdate + INTERVAL '2000' HOUR").alias("at"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    app = o.where("o_orderkey % 2 = 0").select(
        job,
        plan.alias("plan_hash"),
        F.concat(F.lit("a"), "o_orderkey").alias("approver"),
        F.when(F.col("o_orderkey") % 10 == 0, "some day").otherwise(iso).alias("approved_at"),
        F.col("o_orderkey").alias("seq"),
    )
    out = lookups.valid_approval(req, app, "at", 8000 * 3600, order="seq")
    return out.select("o_orderkey", "approved", "approver")


@query(
    "lineage_check",
    """WITH b AS (SELECT o_orderkey, 'c' || (o_orderkey % 50) AS c, 'p' || (o_orderkey % 31) AS p,
                         'r' || (o_orderkey % 23) AS r, 'e' || o_orderkey AS e FROM orders)
    SELECT o_orderkey, CASE
      WHEN o_orderkey % 50 >= 45 THEN 'Invalid contract hash'
      WHEN o_orderkey % 31 >= 28 THEN 'Invalid plan hash'
      WHEN o_orderkey % 23 >= 21 THEN 'Invalid intelligence hash'
      WHEN o_orderkey % 9 = 0 THEN 'Invalid policy evaluation hash'
      WHEN o_orderkey % 8 = 0 THEN 'Policy evaluation does not match contract hash'
      WHEN o_orderkey % 7 = 0 THEN 'Policy evaluation does not match plan hash'
      WHEN o_orderkey % 6 = 0 THEN 'Policy evaluation does not match intelligence hash'
      WHEN o_orderkey % 5 = 0 THEN 'Build blocked by policy' END AS failure
    FROM b""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")

    def hashed(letter: str, n: int):
        return F.concat(F.lit(letter), k % n)

    job = F.lit("job").alias("job_name")
    builds = o.select(
        k,
        job,
        hashed("c", 50).alias("contract_hash"),
        hashed("p", 31).alias("plan_hash"),
        hashed("r", 23).alias("intelligence_hash"),
        F.concat(F.lit("e"), k).alias("policy_eval_hash"),
    )
    contracts = o.where(k % 50 < 45).select(job, hashed("c", 50).alias("contract_hash"))
    plans = o.where(k % 31 < 28).select(job, hashed("p", 31).alias("plan_hash"))
    reports = o.where(k % 23 < 21).select(job, hashed("r", 23).alias("intelligence_hash"))
    evals = builds.where(k % 9 != 0).select(
        "job_name",
        "policy_eval_hash",
        F.when(k % 8 != 0, F.col("contract_hash")).alias("contract_hash"),
        F.when(k % 7 != 0, F.col("plan_hash")).otherwise("other").alias("plan_hash"),
        F.when(k % 6 != 0, F.col("intelligence_hash")).otherwise("other").alias("intelligence_hash"),
        F.when(k % 5 == 0, "BLOCK").otherwise("ALLOW").alias("decision"),
    )
    return lookups.lineage_check(builds, contracts, plans, reports, evals).select("o_orderkey", "failure")


_RULES = {"api": ["/en/", "example.com"], "policy": ["ref="], "blog": ["blog."], "web": ["http"]}
AREAS_SQL = """
areas AS (
  SELECT url, a AS area, CASE a WHEN 'policy' THEN 'high' WHEN 'api' THEN 'medium' ELSE 'low' END AS severity
  FROM pages, (VALUES ('api'), ('policy'), ('blog'), ('web')) v(a)
  WHERE CASE a WHEN 'api' THEN contains(url, '/en/') OR contains(url, 'example.com') WHEN 'policy' THEN contains(url, 'ref=')
        WHEN 'blog' THEN contains(url, 'blog.') ELSE contains(url, 'http') END)
"""


@query("classify_paths", f"WITH {AREAS_SQL} SELECT url, area, severity FROM areas")
def _(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    return lookups.classify_paths(pages, _RULES, "url").select("url", "area", "severity")


@query(
    "impact_summary",
    f"WITH {AREAS_SQL} SELECT area, severity, count(*) AS files FROM areas GROUP BY 1, 2",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    return lookups.impact_summary(lookups.classify_paths(pages, _RULES, "url")).select("area", "severity", "files")


_SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "text_search",
    f"""WITH q AS (SELECT DISTINCT item_id, t FROM (
               SELECT item_id, unnest(string_split_regex(lower(text), '{_SPACES}')) AS t FROM benchmark) WHERE t <> ''),
    n AS (SELECT item_id, count(*) AS m FROM q GROUP BY 1),
    d AS (SELECT DISTINCT doc_id, t FROM (
            SELECT doc_id, unnest(string_split_regex(lower(text), '{_SPACES}')) AS t FROM documents) WHERE t <> ''),
    hits AS (SELECT item_id, doc_id, count(*) AS c FROM q JOIN d USING (t) GROUP BY 1, 2),
    scored AS (SELECT item_id, doc_id, round_even(c / m, 4) AS score FROM hits JOIN n USING (item_id))
    SELECT item_id AS query_id, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= 5""",
)
def _(spark, sf):
    scope = [F.lit("default").alias("tenant"), F.lit("corpus").alias("collection")]
    q = table(spark, sf, "benchmark").select(*scope, F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = table(spark, sf, "documents").select(*scope, "doc_id", "text", F.col("doc_id").alias("seq"))
    return text_search(q, d, 5).select("query_id", "doc_id", "score")


@query(
    "text_search_by_tenant",
    f"""WITH q AS (SELECT DISTINCT query_id, lang, t FROM (
               SELECT doc_id AS query_id, lang, unnest(string_split_regex(lower(text), '{_SPACES}')) AS t
               FROM documents) WHERE t <> ''),
    n AS (SELECT query_id, count(*) AS m FROM q GROUP BY 1),
    d AS (SELECT DISTINCT doc_id, lang, t FROM (
            SELECT doc_id, lang, unnest(string_split_regex(lower(text), '{_SPACES}')) AS t FROM documents) WHERE t <> ''),
    hits AS (SELECT query_id, doc_id, count(*) AS c FROM q JOIN d USING (t, lang) GROUP BY 1, 2),
    scored AS (SELECT query_id, doc_id, round_even(c / m, 4) AS score FROM hits JOIN n USING (query_id))
    SELECT query_id, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= 3""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("tenant"), F.lit("corpus").alias("collection"), "doc_id", "text", F.col("doc_id").alias("seq")
    )
    q = docs.select("tenant", "collection", F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    # low bounds, so that heavy words and their cells occur at every scale
    return text_search(q, docs, 3, light_rows=20, cell_rows=100).select("query_id", "doc_id", "score")
