"""Presets, steps, merges, SCD, CDC and increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.plans import (
    ChangeDetectionSpec,
    IncrementalSpec,
    ModelSpec,
    PipelineSpec,
    ScdSpec,
    Step,
    apply_preset,
    apply_steps,
    backfill_window,
    cdc_apply,
    incremental_filter,
    incremental_load,
    late_arrival_scd2,
    materialize,
    preset_cast,
    preset_dedup,
    preset_filter,
    preset_join,
    scd1_apply,
    scd2_apply,
    scd2_initial,
    with_run_ts,
)
from flowtally.queries.base import day, query, table
from flowtally.sinks import insert_if_absent, merge_upsert

AS_OF = "2024-01-01 00:00:00"
LOADED = "2020-01-01 00:00:00"


@query("read_table", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    return table(spark, sf, "region")


@query("preset_copy", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    return apply_preset(table(spark, sf, "nation"), PipelineSpec("copy", preset="enterprise_a"))


@query(
    "preset_cast",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus
       FROM orders""",
)
def _(spark, sf):
    return preset_cast(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query(
    "with_run_ts",
    "SELECT s_suppkey, '2024-01-01 00:00:00' AS run_ts FROM supplier",
)
def _(spark, sf):
    return with_run_ts(table(spark, sf, "supplier").select("s_suppkey"), AS_OF).withColumn("run_ts", day("run_ts"))


@query(
    "preset_filter",
    """SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment
       FROM customer WHERE c_custkey % 9 <> 0""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    )
    return preset_filter(c, "c_mktsegment")


@query(
    "preset_dedup",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders)
       WHERE n = 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return preset_dedup(o, "o_custkey", ["o_totalprice"])


@query(
    "preset_join",
    """SELECT c.c_nationkey AS n_nationkey, c.c_custkey, n.n_name, n.n_regionkey
       FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON c.c_nationkey = n.n_nationkey""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return preset_join(c, table(spark, sf, "nation").where("n_nationkey % 4 <> 0"), "n_nationkey")


@query(
    "apply_steps",
    """SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 4) AS balance
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name""",
)
def _(spark, sf):
    steps = [
        Step("keep", "filter", {"condition": "c_acctbal > 0"}),
        Step("cols", "select", {"cols": ["c_nationkey", "c_acctbal"]}),
        Step("nation", "join", {"on": "c_nationkey", "how": "left"}),
        Step(
            "sum",
            "aggregate",
            {"group_by": ["n_name"], "aggs": {"customers": "count(1)", "balance": "round(sum(c_acctbal), 4)"}},
        ),
    ]
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return apply_steps(table(spark, sf, "customer"), steps, {"nation": nation})


def _staged(df: DataFrame) -> DataFrame:
    """Next delivery of customers: some changed, some NULL, some gone, some new."""
    k = F.col("c_custkey")
    changed = df.where(k % 13 != 0).select(
        "c_custkey",
        "c_name",
        F.when(k % 7 == 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(k % 11 != 0, F.col("c_acctbal")).alias("c_acctbal"),
    )
    new = df.where(k % 5 == 0).select(
        (k + 100_000_000).alias("c_custkey"), "c_name", "c_mktsegment", "c_acctbal"
    )
    return changed.unionByName(new)


STAGED_SQL = """
staged AS (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment,
         CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS c_acctbal
  FROM customer WHERE c_custkey % 13 <> 0
  UNION ALL
  SELECT c_custkey + 100000000, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 = 0)
"""

_COLS = ("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
_CUSTOMER_SCD = ScdSpec("scd2", ("c_custkey",), ChangeDetectionSpec("hash", ("c_mktsegment", "c_acctbal")))


def scd2_customers(spark, sf, strategy: str = "hash") -> DataFrame:
    spec = ScdSpec("scd2", ("c_custkey",), ChangeDetectionSpec(strategy, ("c_mktsegment", "c_acctbal")))
    c = table(spark, sf, "customer").select(*_COLS)
    out = scd2_apply(scd2_initial(c, spec, LOADED), _staged(c), spec, AS_OF)
    return out.withColumns({"effective_dt": day("effective_dt"), "end_dt": day("end_dt")})


SCD2_SQL = f"""
WITH {STAGED_SQL},
pairs AS (
  SELECT c.c_custkey IS NOT NULL AS has_old, s.c_custkey IS NOT NULL AS has_new,
         c.c_custkey AS ok, c.c_name AS onm, c.c_mktsegment AS os, c.c_acctbal AS ob,
         s.c_custkey AS nk, s.c_name AS nn, s.c_mktsegment AS ns, s.c_acctbal AS nb,
         c.c_mktsegment IS DISTINCT FROM s.c_mktsegment OR c.c_acctbal IS DISTINCT FROM s.c_acctbal AS differs
  FROM customer c FULL JOIN staged s ON c.c_custkey = s.c_custkey)
SELECT ok AS c_custkey, onm AS c_name, os AS c_mktsegment, ob AS c_acctbal, '{LOADED}' AS effective_dt,
       CASE WHEN has_new AND differs THEN '{AS_OF}' ELSE '9999-12-31 00:00:00' END AS end_dt,
       NOT (has_new AND differs) AS is_current
FROM pairs WHERE has_old
UNION ALL
SELECT nk, nn, ns, nb, '{AS_OF}', '9999-12-31 00:00:00', TRUE
FROM pairs WHERE has_new AND (NOT has_old OR differs)
"""


@query("scd2_apply", SCD2_SQL)
def _(spark, sf):
    return scd2_customers(spark, sf)


@query("scd2_apply_column_compare", SCD2_SQL)
def _(spark, sf):
    return scd2_customers(spark, sf, "column_compare")


@query(
    "surrogate_key",
    """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"__at":1577836800000000}') AS customer_sk
       FROM customer""",
)
def _(spark, sf):
    spec = ScdSpec(
        "scd2", ("c_custkey",), ChangeDetectionSpec("hash", ("c_name",)), surrogate_key="customer_sk"
    )
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return scd2_initial(c, spec, LOADED).select("c_custkey", "customer_sk")


UPSERT_SQL = f"""
WITH {STAGED_SQL}
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM staged)
UNION ALL SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM staged
"""


@query("scd1_apply", UPSERT_SQL)
def _(spark, sf):
    c = table(spark, sf, "customer").select(*_COLS)
    return scd1_apply(c, _staged(c), ["c_custkey"])


@query(
    "merge_upsert",
    """WITH src AS (
         SELECT o_custkey AS c_custkey, 'order ' || o_orderkey AS c_name FROM (
           SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1)
       SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM src)
       UNION ALL SELECT c_custkey, c_name FROM src""",
)
def _(spark, sf):
    target = table(spark, sf, "customer").select("c_custkey", "c_name")
    source = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.concat(F.lit("order "), "o_orderkey").alias("c_name"),
        "o_orderkey",
    )
    return merge_upsert(target, source, ["c_custkey"], ["o_orderkey"])


@query(
    "insert_if_absent",
    """SELECT sha256(text) AS content_hash, length(text) AS chars FROM documents
       WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)
       GROUP BY text""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("bigint").alias("chars")
    )
    stored = d.where("doc_id % 3 = 0").select("content_hash", "chars")
    return insert_if_absent(stored, d.select("content_hash", "chars"), "content_hash")


@query(
    "insert_if_absent_ordered",
    """SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents
       WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)
       GROUP BY text""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    stored = d.where("doc_id % 3 = 0")
    return insert_if_absent(stored, d.select("content_hash", "doc_id"), "content_hash", ["doc_id"])


def _changes(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.when(F.col("o_orderkey") % 6 == 0, "D").when(F.col("o_orderkey") % 6 == 1, "I").otherwise("U").alias("op"),
        F.concat(F.lit("change "), "o_orderkey").alias("c_name"),
        "o_orderkey",
    ).unionByName(
        table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(
            (F.col("o_custkey") + 100_000_000).alias("c_custkey"),
            F.when(F.col("o_orderkey") % 100 == 0, "D").otherwise("I").alias("op"),
            F.concat(F.lit("new "), "o_orderkey").alias("c_name"),
            "o_orderkey",
        )
    )


@query(
    "cdc_apply",
    """WITH changes AS (
         SELECT o_custkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'I' ELSE 'U' END AS op,
                'change ' || o_orderkey AS v, o_orderkey AS o FROM orders
         UNION ALL
         SELECT o_custkey + 100000000, CASE WHEN o_orderkey % 100 = 0 THEN 'D' ELSE 'I' END,
                'new ' || o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 50 = 0),
       lst AS (SELECT * FROM changes c WHERE o = (SELECT max(o) FROM changes d WHERE d.k = c.k))
       SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM lst)
       UNION ALL SELECT k, v FROM lst WHERE op <> 'D'""",
)
def _(spark, sf):
    target = table(spark, sf, "customer").select("c_custkey", "c_name")
    return cdc_apply(target, _changes(spark, sf), ["c_custkey"], ["o_orderkey"])


@query(
    "cdc_apply_null_keys",
    """WITH changes AS (
         SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'D' ELSE 'I' END AS op,
                'change ' || o_orderkey AS v, o_orderkey AS o FROM orders),
       lst AS (SELECT * FROM changes WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY o DESC) = 1
               UNION ALL SELECT * FROM changes WHERE k IS NULL)
       SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM lst WHERE k IS NOT NULL)
       UNION ALL SELECT k, v FROM lst WHERE op <> 'D'""",
)
def _(spark, sf):
    o = F.col("o_orderkey")
    changes = table(spark, sf, "orders").select(
        F.when(o % 7 != 0, F.col("o_custkey")).alias("c_custkey"),
        F.when(o % 6 == 0, "D").otherwise("I").alias("op"),
        F.concat(F.lit("change "), o).alias("c_name"),
        "o_orderkey",
    )
    target = table(spark, sf, "customer").select("c_custkey", "c_name")
    return cdc_apply(target, changes, ["c_custkey"], ["o_orderkey"])


@query(
    "incremental_filter",
    """SELECT o_orderkey FROM orders
       WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    target = o.where("o_orderdate < timestamp_ntz'1999-01-01'")
    return incremental_filter(o, target, "o_orderdate").select("o_orderkey")


INCREMENTAL_SQL = """
WITH target AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
fresh AS (
  SELECT o_custkey, o_orderkey, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
  FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM target))
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM target
UNION ALL
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM fresh WHERE n = 1
"""


@query("incremental_load", INCREMENTAL_SQL)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    target = o.where("o_orderdate < timestamp_ntz'1999-01-01'")
    spec = IncrementalSpec("o_orderdate", True, ("o_custkey",))
    return incremental_load(target, o, spec, ["o_orderkey"]).withColumn("o_orderdate", day("o_orderdate"))


@query(
    "backfill_window",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-30'""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    start, end = F.lit("1997-03-01").cast("timestamp_ntz"), F.lit("1997-04-30").cast("timestamp_ntz")
    return backfill_window(o, start, end, "o_orderdate").select("o_orderkey", day("o_orderdate").alias("o_orderdate"))


@query("materialize_full", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return materialize(ModelSpec("customer", "full", ("c_custkey", "c_name")), c, c.limit(0))


@query("materialize_incremental", INCREMENTAL_SQL)
def _(spark, sf):
    o = table(spark, sf, "orders")
    cols = ("o_custkey", "o_orderkey", "o_orderdate")
    spec = ModelSpec("orders", "incremental", cols, incremental=IncrementalSpec("o_orderdate", True, ("o_custkey",)))
    target = o.where("o_orderdate < timestamp_ntz'1999-01-01'").select(*cols)
    return materialize(spec, o, target, order_by=["o_orderkey"]).withColumn("o_orderdate", day("o_orderdate"))


@query("materialize_scd1", UPSERT_SQL)
def _(spark, sf):
    c = table(spark, sf, "customer").select(*_COLS)
    return materialize(ModelSpec("customer", "scd1", _COLS, scd=_CUSTOMER_SCD), _staged(c), c)


@query("materialize_scd2", SCD2_SQL)
def _(spark, sf):
    c = table(spark, sf, "customer").select(*_COLS)
    spec = ModelSpec("customer", "scd2", _COLS, scd=_CUSTOMER_SCD)
    out = materialize(spec, _staged(c), scd2_initial(c, _CUSTOMER_SCD, LOADED), as_of=AS_OF)
    return out.withColumns({"effective_dt": day("effective_dt"), "end_dt": day("end_dt")})


@query(
    "late_arrival_scd2",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS effective_dt,
              coalesce(strftime(lead(o_orderdate) OVER w, '%Y-%m-%d %H:%M:%S'), '9999-12-31 00:00:00') AS end_dt,
              lead(o_orderdate) OVER w IS NULL AS is_current
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def _(spark, sf):
    h = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("effective_dt"))
    out = late_arrival_scd2(h, ["o_custkey"], tie_break=["o_orderkey"])
    return out.withColumns({"effective_dt": day("effective_dt"), "end_dt": day("end_dt")})


@query(
    "late_arrival_scd2_hot_key",
    """WITH h AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN -1 ELSE o_custkey END AS o_custkey, o_orderkey,
                        date_trunc('year', o_orderdate) AS d FROM orders)
       SELECT o_custkey, o_orderkey, strftime(d, '%Y-%m-%d %H:%M:%S') AS effective_dt,
              coalesce(strftime(lead(d) OVER w, '%Y-%m-%d %H:%M:%S'), '9999-12-31 00:00:00') AS end_dt,
              lead(d) OVER w IS NULL AS is_current
       FROM h WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey)""",
)
def _(spark, sf):
    h = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 > 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("o_custkey"),
        "o_orderkey",
        F.date_trunc("year", "o_orderdate").alias("effective_dt"),
    )
    out = late_arrival_scd2(h, ["o_custkey"], tie_break=["o_orderkey"], chunk_rows=500)
    return out.withColumns({"effective_dt": day("effective_dt"), "end_dt": day("end_dt")})
