"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtally import functions as fn
from flowtally.queries.base import day, query, table
from flowtally.skew import with_previous


@query(
    "content_hash",
    """SELECT c_custkey, sha256(h) AS content_hash, substr(sha256(h), 1, 16) AS content_hash_prefix FROM (
         SELECT c_custkey, '{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS h FROM customer)""",
)
def _(spark, sf):
    cols = ["c_name", "c_mktsegment"]
    return table(spark, sf, "customer").select(
        "c_custkey",
        fn.content_hash(cols).alias("content_hash"),
        fn.content_hash(cols, prefix=16).alias("content_hash_prefix"),
    )


@query(
    "change_hash",
    """SELECT c_custkey, md5(c_name || '|' || seg) AS bar_hash,
              sha256('{"c_name":"' || c_name || '","seg":' || coalesce('"' || seg || '"', 'null') || '}') AS safe_hash
       FROM (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg FROM customer)""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("seg", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    return c.select(
        "c_custkey",
        fn.change_hash(["c_name", "seg"], compat=True).alias("bar_hash"),
        fn.change_hash(["c_name", "seg"]).alias("safe_hash"),
    )


@query("month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.month_key("o_orderdate").alias("month"))


@query(
    "parse_iso_utc",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL
              WHEN 1 THEN strftime(ts - to_hours(2), '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed
       FROM events""",
)
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit(" "), iso, F.lit("Z")))
        .when(k == 1, F.concat(iso, F.lit("+02:00")))
        .when(k == 2, iso)
        .otherwise(F.concat(F.lit("at "), iso))
    )
    return table(spark, sf, "events").select("event_id", day(fn.parse_iso_utc(text)).alias("parsed"))


@query(
    "display_ts",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
              ELSE strftime(make_timestamp((1700000000000 + event_id * 1000) * 1000), '%Y-%m-%d %H:%M:%S') END AS shown
       FROM events""",
)
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("event_id") % 3 == 0, iso).when(F.col("event_id") % 3 == 1, "  ")
    shown = fn.display_ts(text, F.lit(1_700_000_000_000) + F.col("event_id") * 1000)
    return table(spark, sf, "events").select("event_id", day(shown).alias("shown"))


@query(
    "audit_details",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'details of ' || event_type WHEN event_id % 5 = 1 THEN 'said ' || user_id
         WHEN event_id % 5 = 2 THEN 'GET /u/' || user_id || ' (?)' WHEN event_id % 5 = 3 THEN '? /u/' || user_id || ' (200)'
         ELSE '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' END AS details
       FROM events""",
)
def _(spark, sf):
    k = F.col("event_id") % 5
    http = F.when(
        k.isin(2, 3),
        F.struct(
            F.when(k == 2, "GET").alias("method"),
            F.concat(F.lit("/u/"), "user_id").alias("path"),
            F.when(k == 3, 200).alias("status"),
        ),
    )
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(k == 0, F.concat(F.lit("details of "), "event_type")).when(k == 1, " ").alias("d"),
        F.when(k == 1, F.concat(F.lit("said "), "user_id")).alias("m"),
        http.alias("http"),
        F.struct("event_id", "event_type").alias("record"),
    )
    return e.select("event_id", fn.audit_details("d", "m", "http", "record").alias("details"))


@query(
    "audit_actor_event",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id WHEN event_id % 3 = 1 THEN event_type ELSE '—' END AS actor,
              CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'http' END AS event FROM events""",
)
def _(spark, sf):
    k = F.col("event_id")
    none = F.lit(None).cast("string")
    e = table(spark, sf, "events")
    actor = fn.audit_actor(F.when(k % 3 == 0, F.concat(F.lit("u"), "user_id")), F.when(k % 3 == 1, F.col("event_type")))
    event = fn.audit_event(none, F.when(k % 2 == 0, F.col("event_type")), F.lit("http"))
    return e.select("event_id", actor.alias("actor"), event.alias("event"))


@query(
    "safe_identifier",
    r"""SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_\-]', '_', 'g') AS plain,
              trim(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_\-]', '_', 'g'), '_+', '_', 'g'), '_') AS job,
              substr(regexp_replace(trim(url || ' é'), '[^\p{L}\p{N}_\-]', '_', 'g'), 1, 64) AS task
       FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        fn.safe_identifier("url").alias("plain"),
        fn.safe_identifier("url", "job").alias("job"),
        fn.safe_identifier(F.concat("url", F.lit(" é")), "task").alias("task"),
    )


@query(
    "glob_match",
    """SELECT url, url GLOB '*/en/*' OR url GLOB 'https://blog.*[0-9]/' OR url GLOB '*.htm?' AS matched FROM pages""",
)
def _(spark, sf):
    globs = ["*/en/*", "https://blog.*[0-9]/", "*.htm?"]
    return table(spark, sf, "pages").select("url", fn.glob_match("url", globs).alias("matched"))


@query(
    "validity_checks",
    r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '0 6 * * ' || (p_size % 7) WHEN 1 THEN ' */5  * * * * '
                     WHEN 2 THEN '0 6 * *' ELSE p_name END AS cron,
              CASE p_partkey % 3 WHEN 0 THEN p_type || '.' || p_size WHEN 1 THEN p_brand || '.x' ELSE p_type END AS tab,
              CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE p_type || '-' || p_size || '_x' END AS job FROM part)
    SELECT p_partkey, len(list_filter(string_split_regex(trim(cron), '\s+'), lambda x: x <> '')) = 5 AS cron_ok,
           regexp_full_match(trim(tab), '[A-Za-z0-9_]+\.[A-Za-z0-9_]+') AS table_ok,
           regexp_full_match(job, '[A-Za-z0-9_-]{1,128}') AS job_ok FROM s""",
)
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    s = table(spark, sf, "part").select(
        k,
        F.when(k % 4 == 0, F.concat(F.lit("0 6 * * "), size % 7))
        .when(k % 4 == 1, " */5  * * * * ")
        .when(k % 4 == 2, "0 6 * *")
        .otherwise(F.col("p_name"))
        .alias("cron"),
        F.when(k % 3 == 0, F.concat("p_type", F.lit("."), size))
        .when(k % 3 == 1, F.concat("p_brand", F.lit(".x")))
        .otherwise(F.col("p_type"))
        .alias("tab"),
        F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.concat("p_type", F.lit("-"), size, F.lit("_x"))).alias("job"),
    )
    return s.select(
        "p_partkey",
        fn.valid_cron("cron").alias("cron_ok"),
        fn.valid_table("tab").alias("table_ok"),
        fn.valid_job_name("job").alias("job_ok"),
    )


# Requirement texts out of orders; parts of the text come and go with the key
TEXT_SQL = """
texts AS (SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Job Name: job__' || o_custkey ELSE 'please build' END
  || CASE o_orderkey % 3 WHEN 0 THEN ' env=QA' WHEN 1 THEN ' environment: prod' ELSE ' env=test' END
  || CASE WHEN o_orderkey % 5 < 3 THEN ' read from raw.t' || (o_custkey % 10) ELSE ' source table = raw.s' || (o_custkey % 7) END
  || CASE WHEN o_orderkey % 7 < 4 THEN chr(10) || ' write  to cur.t' || (o_custkey % 9) ELSE '' END
  || CASE WHEN o_orderkey % 11 < 6 THEN ' partitioned by dt' || (o_custkey % 4) ELSE ' partition_column: dd' END
  || CASE o_orderkey % 4 WHEN 0 THEN ' schedule: 0 6 * * 1 owner: me@x.org' WHEN 1 THEN ' cron: 5 * *' || CASE WHEN o_orderkey % 8 = 1 THEN ' * *' ELSE '' END
       WHEN 2 THEN ' append Scala' ELSE ' schedule: soon' END
  || ' timezone: Europe/Berlin end' AS text
  FROM orders)
"""


def _texts(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        """concat(
          CASE WHEN o_orderkey % 2 = 0 THEN concat('Job Name: job__', o_custkey) ELSE 'please build' END,
          CASE o_orderkey % 3 WHEN 0 THEN ' env=QA' WHEN 1 THEN ' environment: prod' ELSE ' env=test' END,
          CASE WHEN o_orderkey % 5 < 3 THEN concat(' read from raw.t', o_custkey % 10) ELSE concat(' source table = raw.s', o_custkey % 7) END,
          CASE WHEN o_orderkey % 7 < 4 THEN concat('\n write  to cur.t', o_custkey % 9) ELSE '' END,
          CASE WHEN o_orderkey % 11 < 6 THEN concat(' partitioned by dt', o_custkey % 4) ELSE ' partition_column: dd' END,
          CASE o_orderkey % 4 WHEN 0 THEN ' schedule: 0 6 * * 1 owner: me@x.org' WHEN 1 THEN concat(' cron: 5 * *', CASE WHEN o_orderkey % 8 = 1 THEN ' * *' ELSE '' END)
               WHEN 2 THEN ' append Scala' ELSE ' schedule: soon' END,
          ' timezone: Europe/Berlin end') AS text""",
    )


@query(
    "extract_spec",
    f"""WITH {TEXT_SQL}, f AS (SELECT o_orderkey,
      CASE WHEN o_orderkey % 2 = 0 THEN 'job_' || o_custkey ELSE 'example_pipeline' END AS job_name,
      CASE o_orderkey % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'prod' ELSE 'dev' END AS env,
      'Europe/Berlin' AS timezone,
      CASE WHEN o_orderkey % 4 = 0 THEN '0 6 * * 1' WHEN o_orderkey % 8 = 1 THEN '5 * * * *' ELSE '0 6 * * *' END AS schedule,
      CASE WHEN o_orderkey % 4 = 0 THEN 'me@x.org' ELSE 'data-platform' END AS owner,
      CASE WHEN o_orderkey % 4 = 2 THEN 'scala' ELSE 'pyspark' END AS language,
      CASE WHEN o_orderkey % 5 < 3 THEN 'raw.t' || (o_custkey % 10) ELSE 'raw.s' || (o_custkey % 7) END AS source_table,
      CASE WHEN o_orderkey % 7 < 4 THEN 'cur.t' || (o_custkey % 9) ELSE 'curated_db.target_table' END AS target_table,
      CASE WHEN o_orderkey % 11 < 6 THEN 'dt' || (o_custkey % 4) ELSE 'dd' END AS partition_column,
      CASE WHEN o_orderkey % 4 = 2 THEN 'append' ELSE 'merge' END AS write_mode,
      'Generated from requirement' AS description, CASE o_orderkey % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'prod' ELSE 'dev' END AS tags,
      [CASE WHEN o_orderkey % 2 = 0 THEN 'job_name.sanitized' ELSE 'job_name.missing' END,
       CASE WHEN o_orderkey % 3 = 2 THEN 'env.missing' END,
       CASE WHEN o_orderkey % 8 = 5 THEN 'schedule.invalid' WHEN o_orderkey % 4 > 1 THEN 'schedule.missing' END,
       CASE WHEN o_orderkey % 7 >= 4 THEN 'target_table.missing' END] AS w
      FROM texts)
    SELECT * EXCLUDE (w), array_to_string(list_filter(w, lambda x: x IS NOT NULL), ',') AS warnings,
           greatest(0.5::DOUBLE, round(1 - 0.1::DOUBLE * len(list_filter(w, lambda x: x IS NOT NULL)), 2)) AS confidence
    FROM f""",
)
def _(spark, sf):
    out = fn.extract_spec(_texts(spark, sf), "text")
    return out.drop("o_custkey", "text", "preset").withColumns({c: F.array_join(c, ",") for c in ("warnings", "tags")})


@query(
    "normalize_path",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/api/v1/modeling/:name' WHEN 1 THEN '/api/v1/tenants/:tenant/health'
         WHEN 2 THEN '/run/:hex/:id' WHEN 3 THEN '/job/:uuid/x' ELSE '/' END AS normal FROM pages""",
)
def _(spark, sf):
    k = F.col("page_id")
    digest = F.sha2("url", 256)
    uuid = F.concat_ws(
        "-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    path = (
        F.when(k % 5 == 0, F.concat(F.lit("/api/v1/modeling/m_"), k))
        .when(k % 5 == 1, F.concat(F.lit("/api/v1/tenants/t"), k, F.lit("/health")))
        .when(k % 5 == 2, F.concat(F.lit("/run/"), digest, F.lit("/"), k))
        .when(k % 5 == 3, F.concat(F.lit("/job/"), uuid, F.lit("/x")))
        .otherwise("")
    )
    return table(spark, sf, "pages").select("page_id", fn.normalize_path(path).alias("normal"))


@query(
    "scope_for_path",
    r"""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'dags' WHEN 2 THEN 'configs' ELSE 'jobs' END AS scope FROM documents""",
)
def _(spark, sf):
    k = F.col("doc_id")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("jobs/"), k))
        .when(k % 4 == 1, F.concat(F.lit("dags\\"), k))
        .when(k % 4 == 2, "configs")
        .otherwise(F.concat(F.lit("dagsx/"), k))
    )
    scope = fn.scope_for_path(path, ["jobs", "/dags/", " ", "configs"])
    return table(spark, sf, "documents").select("doc_id", scope.alias("scope"))


@query(
    "classify_error",
    """SELECT doc_id, CASE WHEN t LIKE '%oom%' OR t LIKE '%out of memory%' THEN 'OOM' WHEN t LIKE '%timeout%' THEN 'network_timeout'
         WHEN t LIKE '%policy%' THEN 'policy_violation' WHEN t LIKE '%quota%' OR t LIKE '%budget%' THEN 'quota_exceeded'
         WHEN t LIKE '%corrupt%' THEN 'data_corruption' ELSE 'unknown' END AS root_cause
       FROM (SELECT doc_id, lower(text || CASE doc_id % 8 WHEN 0 THEN ' OOM killed' WHEN 1 THEN ' Out Of Memory' WHEN 2 THEN ' read Timeout policy'
              WHEN 3 THEN ' Policy budget' WHEN 4 THEN ' QUOTA' WHEN 5 THEN ' corrupt block' ELSE '' END) AS t FROM documents)""",
)
def _(spark, sf):
    k = F.col("doc_id") % 8
    tail = (
        F.when(k == 0, " OOM killed")
        .when(k == 1, " Out Of Memory")
        .when(k == 2, " read Timeout policy")
        .when(k == 3, " Policy budget")
        .when(k == 4, " QUOTA")
        .when(k == 5, " corrupt block")
        .otherwise("")
    )
    text = F.concat("text", tail)
    return table(spark, sf, "documents").select("doc_id", fn.classify_error(text).alias("root_cause"))


_SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "token_count",
    f"""SELECT doc_id, greatest(1, len(list_filter(string_split_regex(text, '{_SPACES}'), lambda x: x <> ''))) AS prompt_tokens
        FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.token_count("text").alias("prompt_tokens"))


@query(
    "token_cost",
    """SELECT o_orderkey, round(o_custkey * 1e-6::DOUBLE + o_orderkey * 2e-6::DOUBLE, 6) AS cost_usd FROM orders""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.token_cost("o_custkey", "o_orderkey").alias("cost_usd"))


@query(
    "markdown_headers",
    r"""WITH m AS (SELECT doc_id, regexp_replace(text, '\n', chr(10) || '  # ', 'g') AS t FROM documents),
    l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(x)), lambda x: starts_with(x, '#')) AS h FROM m)
    SELECT doc_id, len(h) AS headers, CAST(coalesce(list_sum(list_transform(h, lambda x: length(x))), 0) AS BIGINT) AS chars FROM l""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n  # ").alias("t"))
    h = d.select("doc_id", fn.markdown_headers("t").alias("h"))
    total = F.aggregate("h", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    return h.select("doc_id", F.size("h").alias("headers"), total.alias("chars"))


@query(
    "json_diff",
    """WITH pairs AS (SELECT event_id, props AS after, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT event_id, 'k' AS path, 'modified' AS change FROM pairs
    WHERE before IS NOT NULL AND (before->>'k') <> (after->>'k')""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("props").alias("after"))
    pairs = with_previous(e, ["user_id"], ["event_id"], {"before": "after"})
    return fn.json_diff(pairs, "before", "after").select("event_id", "path", "change")


@query(
    "json_diff_nested",
    """SELECT o_orderkey, 'extra' AS path, 'added' AS change FROM orders WHERE o_orderkey % 4 = 0
       UNION ALL SELECT o_orderkey, 'gone', 'removed' FROM orders WHERE o_orderkey % 5 = 0
       UNION ALL SELECT o_orderkey, 'in.cust', 'modified' FROM orders WHERE o_orderkey % 3 = 0
       UNION ALL SELECT o_orderkey, 'in.deep.list', 'modified' FROM orders WHERE o_orderkey % 7 = 0
       UNION ALL SELECT o_orderkey, 'in.deep.new', 'added' FROM orders WHERE o_orderkey % 11 = 0""",
)
def _(spark, sf):
    docs = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """concat('{"status": "', o_orderstatus, '", "in": {"cust": ', o_custkey, ', "deep": {"list": [1, ', o_orderkey,
             ']}}', CASE WHEN o_orderkey % 5 = 0 THEN ', "gone": {"a": 1}' ELSE '' END, '}') AS before""",
        """concat('{"in": {"deep": {"list": [', CASE WHEN o_orderkey % 7 = 0 THEN '2' ELSE '1' END, ', ', o_orderkey, ']',
             CASE WHEN o_orderkey % 11 = 0 THEN ', "new": null' ELSE '' END, '}, "cust": ',
             CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END, '}',
             CASE WHEN o_orderkey % 4 = 0 THEN ', "extra": {"b": {"c": 2}}' ELSE '' END,
             ', "status": "', o_orderstatus, '"}') AS after""",
    )
    return fn.json_diff(docs, "before", "after").select("o_orderkey", "path", "change")


_DEEP = 12


@query(
    "json_diff_deep",
    f"""SELECT o_orderkey, '{"a." * _DEEP}leaf' AS path, 'modified' AS change FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, '{"a." * _DEEP}list', 'modified' FROM orders WHERE o_orderkey % 5 = 0""",
)
def _(spark, sf):
    """Twelve levels; numbers written in another way are equal, other numbers are not."""

    def nested(leaf, same, items):
        head, tail = F.lit('{"a": ' * _DEEP), F.lit("}" * _DEEP)
        return F.concat(head, F.lit('{"leaf": '), leaf, F.lit(', "same": '), same, F.lit(', "list": ['), items, F.lit("]}"), tail)

    key = F.col("o_orderkey")
    k = key + 1  # no leading zeros
    before = nested(k.cast("string"), F.concat(k, F.lit("e2")), F.concat(k, F.lit(", [1.50, 2]")))
    leaf = F.when(key % 3 == 0, F.concat(k, F.lit(".5"))).otherwise(F.concat(k, F.lit(".0")))
    items = F.concat(k, F.lit(".00, [1.5, "), F.when(key % 5 == 0, "3").otherwise("2.0"), F.lit("]"))
    after = nested(leaf, F.concat(k, F.lit("00")), items)
    docs = table(spark, sf, "orders").select("o_orderkey", before.alias("before"), after.alias("after"))
    return fn.json_diff(docs, "before", "after").select("o_orderkey", "path", "change")


@query(
    "json_diff_lists",
    """SELECT o_orderkey, 'items' AS path, 'modified' AS change FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0
       UNION ALL SELECT o_orderkey, 'deep', 'modified' FROM orders WHERE o_orderkey % 7 = 0
       UNION ALL SELECT o_orderkey, 'names', 'modified' FROM orders WHERE o_orderkey % 11 = 0""",
)
def _(spark, sf):
    """Objects and lists inside lists; numbers in them written in another way are equal, texts that look so are not."""
    docs = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """concat('{"items": [{"tags": [', o_orderkey + 1, ', {"v": ', o_orderkey + 1, 'e2}], "qty": ', o_orderkey + 1,
             '}, null], "deep": [[[', o_orderkey + 1, ', {"a": -0.50}]]], "names": ["q\\\\" 1.0", "1.0"]}') AS before""",
        """concat('{"items": [{"qty": ', o_orderkey + 1, IF(o_orderkey % 3 = 0, '.5', '.0'), ', "tags": [', o_orderkey + 1, '.00, {"v": ',
             o_orderkey + 1, IF(o_orderkey % 5 = 0, '01', '00'), '}]}, null], "deep": [[[', o_orderkey + 1, ', {"a": -0.5',
             IF(o_orderkey % 7 = 0, ', "b": 1', ''), '}]]], "names": ["q\\\\" 1.0", "1', IF(o_orderkey % 11 = 0, '', '.0'), '"]}') AS after""",
    )
    return fn.json_diff(docs, "before", "after").select("o_orderkey", "path", "change")


@query(
    "numeric_or_null",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS amount FROM events""",
)
def _(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise("true")
    e = table(spark, sf, "events").select("event_id", fn.parse_json(text).alias("v"))
    return e.select("event_id", fn.numeric_or_null("v").alias("amount"))


@query(
    "explain_finding",
    """SELECT p_partkey, '[' || CASE WHEN p_size % 3 = 0 THEN 'info' ELSE 'warn' END || '] '
         || CASE p_size % 4 WHEN 0 THEN 'plan.no_baseline' WHEN 1 THEN 'basic.strict_mode' WHEN 2 THEN 'odd' ELSE 'unknown.code' END
         || CASE WHEN p_partkey % 2 = 0 THEN ' | ' || p_name ELSE '' END
         || CASE WHEN p_partkey % 5 = 0 THEN ' | Target: ' || p_brand ELSE '' END
         || CASE p_size % 4 WHEN 0 THEN ' | Guidance: No baseline commit/reference was found. Connect upstream or initialize baseline, then re-run.'
            WHEN 1 THEN ' | Guidance: Strict mode is enabled; certain warnings are treated as violations. Adjust advisor options if intended.'
            ELSE '' END AS explanation
       FROM part""",
)
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    code = F.when(size % 4 == 0, "plan.no_baseline").when(size % 4 == 1, "basic.strict_mode").when(size % 4 == 2, "odd")
    text = fn.explain_finding(
        code,
        F.when(size % 3 != 0, "warn").otherwise(""),
        F.when(k % 2 == 0, F.col("p_name")),
        F.when(k % 5 == 0, F.col("p_brand")).otherwise(""),
    )
    return table(spark, sf, "part").select("p_partkey", text.alias("explanation"))


@query(
    "normalize_risk",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN
              greatest(0, least(1, CASE WHEN r > 1 THEN r / 100 ELSE r END)) END AS risk
       FROM (SELECT c_custkey, c_acctbal / 50 AS r FROM customer)""",
)
def _(spark, sf):
    r = F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal") / 50)
    return table(spark, sf, "customer").select("c_custkey", fn.normalize_risk(r).alias("risk"))


@query(
    "normalize_triage",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'OOM' WHEN 1 THEN 'quota_exceeded' ELSE 'unknown' END AS root_cause_class,
         CASE WHEN event_id % 4 = 0 THEN 'high' ELSE 'medium' END AS recurrence_risk,
         CASE WHEN event_id % 5 = 0 THEN 0.55::DOUBLE ELSE greatest(0, least(1, (value - 10) / 10)) END AS confidence,
         CASE WHEN event_id % 2 = 0 THEN 'seen ' || event_type ELSE 'No summary provided.' END AS human_summary,
         'Investigate recent changes and retry.' AS recommended_action
       FROM events""",
)
def _(spark, sf):
    k = F.col("event_id")
    answers = table(spark, sf, "events").select(
        k,
        F.when(k % 3 == 0, "OOM").when(k % 3 == 1, "quota_exceeded").otherwise("disk").alias("root_cause_class"),
        F.when(k % 4 == 0, "high").when(k % 4 == 1, "HIGH").alias("recurrence_risk"),
        F.when(k % 5 == 0, "sure").otherwise(((F.col("value") - 10) / 10).cast("string")).alias("confidence"),
        F.when(k % 2 == 0, F.concat(F.lit("seen "), "event_type")).otherwise("").alias("human_summary"),
        F.lit(None).cast("string").alias("recommended_action"),
    )
    return fn.normalize_triage(answers)
