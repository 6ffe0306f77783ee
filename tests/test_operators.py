from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowtally.operators import aggregates as A
from flowtally.operators import graph as G
from flowtally.operators import lookups as L
from flowtally.operators import ordered as O
from flowtally.operators import reconcile as R
from flowtally.operators import search
from flowtally.operators import sets as S
from flowtally.operators.filters import audit_filter, for_tenant_month
from flowtally.operators.search import text_search
from tests.conftest import rows

LEDGER = "entry_id string, tenant string, month string, job_name string, build_id string, estimated_cost_usd double, actual_cost_usd double"


def test_ledger_breakdown(spark):
    # estimate 20, then actual 5 for one job; actual 2 for an AI job; limit 100
    est = spark.createDataFrame(
        [("t:b1:job", 1, "t", "2024-01", "job_billing_breakdown", "b1", 20.0)],
        "entry_id string, seq int, tenant string, month string, job_name string, build_id string, estimated_cost_usd double",
    )
    act = spark.createDataFrame(
        [
            ("t:b1:job", 2, "t", "2024-01", "job_billing_breakdown", "b1", 5.0, None, None),
            ("t:b2:ai", 3, "t", "2024-01", "ai_intent_gapfill", "b2", 2.0, 4.0, None),
            ("t:b2:ai", 4, "t", "2024-01", "ai_intent_gapfill", "b2", None, None, "2024-01-05"),
        ],
        "entry_id string, seq int, tenant string, month string, job_name string, build_id string, actual_cost_usd double, actual_runtime_seconds double, finished_ts string",
    )
    ledger = O.coalesce_patches(est, act)
    got = rows(ledger.select("entry_id", "estimated_cost_usd", "actual_cost_usd", "actual_runtime_seconds", "finished_ts"))
    assert got == [("t:b1:job", 20.0, 5.0, None, None), ("t:b2:ai", 0.0, 2.0, 4.0, "2024-01-05")]
    budgets = spark.createDataFrame([("t", 100.0)], "tenant string, limit_usd double")
    s = A.billing_summary(ledger, budgets).first()
    assert (s.spent_actual_usd, s.ai_spent_actual_usd, s.non_ai_spent_actual_usd) == (7.0, 2.0, 5.0)
    assert (s.remaining_estimated_usd, s.utilization_estimated, s.budget_status, s.entries_count) == (80.0, 0.2, "ok", 2)
    assert rows(A.spend_by_ai_task(ledger)) == [("t", "2024-01", "ai_intent_gapfill", 2.0)]
    # an estimate written after an actual replaces the whole entry
    again = est.withColumn("seq", F.lit(9))
    assert O.coalesce_patches(est.union(again), act).where("entry_id = 't:b1:job'").first().actual_cost_usd is None


@pytest.mark.parametrize(
    "spent,limit,status,use",
    [(79.0, 100.0, "ok", 0.79), (80.0, 100.0, "warning", 0.8), (100.0, 100.0, "exceeded", 1.0), (5.0, 0.0, "ok", 0.0), (300.0, None, "exceeded", 1.0)],
)
def test_budget_status(spark, spent, limit, status, use):
    ledger = spark.createDataFrame([("e", "t", "m", "j", "b", spent, None)], LEDGER)
    budgets = spark.createDataFrame([("t", limit)], "tenant string, limit_usd double")
    s = A.billing_summary(ledger, budgets).first()
    assert (s.budget_status, s.utilization_estimated) == (status, use)


def test_counters(spark):
    df = spark.createDataFrame(
        [("get", "/a", 200), ("GET", "/a", 500), (None, None, None)], "method string, path string, status int"
    )
    got = {(r.counter, r.method, r.path, r.status): r.requests for r in A.request_counters(df).collect()}
    assert got[("total", None, None, None)] == 3
    assert got[("method", "GET", None, None)] == 2 and got[("method", "UNKNOWN", None, None)] == 1
    assert got[("path", None, "/a", None)] == 2
    assert got[("path_status", None, "/", "unknown")] == 1
    assert got[("method_path_status", "GET", "/a", "500")] == 1
    assert len(got) == 1 + 2 + 2 + 3 + 3
    named = spark.createDataFrame([("a", 2), ("a", 3), ("", 9), (None, 1)], "name string, v int")
    assert rows(A.named_counters(named, value="v")) == [("a", 5)]
    hist = spark.createDataFrame([("GET", "/", 0.1), ("GET", "/", 0.5), ("GET", "/", 9.0)], "method string, path string, s double")
    assert rows(A.histogram_counts(hist, "s", [0.5, 0.1])) == [("GET", "/", 1, 2, 3, 9.6, 3)]


def test_rollups(spark):
    f = spark.createDataFrame([("p", "info"), ("p", "block"), ("q", "warn"), ("r", "odd")], "plan_id string, severity string")
    assert rows(A.max_severity(f, ["plan_id"])) == [("p", "block", "FAIL"), ("q", "warn", "PASS"), ("r", "info", "PASS")]
    assert rows(A.max_severity(f.limit(0))) == [("info", "PASS")]
    assert rows(A.finding_counts(f)) == [("p", 2), ("q", 1), ("r", 1)]
    r = spark.createDataFrame([("a", "FAIL"), ("a", "WARN"), ("b", "WARN")], "job_name string, status string")
    assert rows(A.is_blocking(r)) == [("a", True), ("b", False)]


def test_audit_filter(spark):
    df = spark.createDataFrame(
        [("T1", "Ann", None, "Login"), ("t2", None, "bob", None), (None, None, None, None)],
        "tenant string, actor string, user string, type string",
    )
    assert audit_filter(df).count() == 3
    assert audit_filter(df, tenant="t").count() == 2
    assert rows(audit_filter(df, actor="BOB").select("tenant")) == [("t2",)]
    assert audit_filter(df, event="log", actor="an").count() == 1
    m = spark.createDataFrame([("t", "m"), ("t", "n")], "tenant string, month string")
    assert for_tenant_month(m, "t", "m").count() == 1


def test_snapshot_diff_and_sets(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "path string, v int")
    b = spark.createDataFrame([("y", 3), ("z", None), ("w", 1)], "path string, v int")
    d = R.snapshot_diff(a, b, ["path"])
    assert rows(d.select("path", "status")) == [("w", "added"), ("x", "removed"), ("y", "changed")]
    assert rows(R.diff_summary(d)) == [(1, 1, 1)]
    assert R.snapshot_diff(a, a, ["path"]).count() == 0
    assert rows(S.keys_added(a, b, ["path"])) == [("w",)]
    assert rows(S.keys_removed(a, b, ["path"])) == [("x",)]
    assert rows(S.keys_common(a, b, ["path"])) == [("y",), ("z",)]
    assert S.union_events(a, b.withColumn("e", F.lit(1))).columns == ["path", "v", "e"]
    assert [r.path for r in S.distinct_paths(a.union(b)).collect()] == ["w", "x", "y", "z"]


def test_three_way(spark):
    def side(**h):
        return spark.createDataFrame(list(h.items()), "path string, sha256 string")

    base, up, ws = side(a="1", b="1", c="1", d="1"), side(a="2", b="2", c="1", e="5"), side(a="1", b="3", c="1", d="1")
    items = R.three_way_reconcile(base, up, ws)
    assert rows(items.select("path", "apply_mode", "status")) == [
        ("a", "safe_auto", "M"),
        ("b", "manual", "M"),
        ("d", "safe_auto", "A"),
        ("e", "safe_auto", "D"),
    ]
    assert rows(R.sync_summary(items)) == [(4, 3, 1)]
    for mode in ("diverged", "unrelated_histories"):
        got = R.three_way_reconcile(base, up, ws, mode=mode)
        assert rows(got.select("apply_mode", "reason").distinct()) == [("manual", mode)]
    with pytest.raises(ValueError):
        R.three_way_reconcile(base, up, ws, mode="x")


def test_manifests(spark):
    schema = "path string, sha256 string, size bigint"
    a = spark.createDataFrame([("x", "1", 5), ("packaging_manifest.json", "9", 1)], schema)
    b = spark.createDataFrame([("x", "1", None)], schema)
    assert R.manifest_equal(a, b).first().equal is True
    assert R.manifest_equal(a, b, {"kind": "m"}, {"kind": "n"}).first().equal is False
    assert R.manifest_equal(a, spark.createDataFrame([("x", "1", 6)], schema)).first().equal is False
    assert R.manifest_equal(a, spark.createDataFrame([("y", "1", 5)], schema)).first().equal is False
    exp = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "path string, sha256 string")
    act = spark.createDataFrame([("a", "1"), ("b", "x"), ("e", "5"), ("n", "7")], "path string, sha256 string")
    checks = R.verify_hashes(exp, act)
    assert rows(checks.select("path", "status")) == [
        ("a", "ok"), ("b", "mismatched"), ("c", "missing"), ("e", "extra"), ("n", "unchecked"),
    ]
    assert rows(R.verify_summary(checks)) == [(1, 1, 1, False)]
    assert R.verify_summary(R.verify_hashes(exp.limit(1), act.limit(1)), True).first().ok is True
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    sums = spark.createDataFrame([("a", " 1  a.tar "), ("b", "2 b"), ("d", "1")], "path string, line string")
    got = R.artifact_integrity(want, act, sums)
    assert rows(got.select("path", "valid", "reason")) == [
        ("a", True, None), ("b", False, None), ("c", False, "artifact_missing"), ("d", False, "artifact_missing"),
    ]
    assert R.artifact_integrity(want, act, sums.limit(0)).where("path = 'a'").first().reason == "sha_file_missing"


def test_schema_diff(spark):
    schema = "table_name string, column_name string, data_type string"
    cur = spark.createDataFrame([("t", "a", "int"), ("t", "b", "int"), ("u", "c", "int")], schema)
    new = spark.createDataFrame([("t", "a", "string"), ("t", "d", "int"), ("u", "c", "int")], schema)
    d = R.schema_diff(cur, new)
    assert rows(d) == [("t", "a", "changed"), ("t", "b", "removed"), ("t", "d", "added")]
    assert rows(R.schema_diff_summary(d)) == [("t", 1, 1, 1, True)]


def test_prices(spark):
    df = spark.createDataFrame(
        [("AWS", None), ("aws", "eu-west-1"), ("k8s", None), ("k8s", "x"), ("gcp", "nowhere"), ("odd", "y")],
        "provider string, region string",
    )
    got = [r.vcpu_hour_usd for r in L.with_price(df).collect()]
    assert got == [0.045, 0.052, 0.040, 0.040, 0.05, 0.05]
    own = spark.createDataFrame([("aws", "us-east-1", 0.03), ("gcp", "default", 0.01)], "provider string, region string, price double")
    assert {(r.provider, r.region): r.vcpu_hour_usd for r in L.with_price(df, own).collect()} == {
        ("AWS", None): 0.03, ("aws", "eu-west-1"): 0.052, ("k8s", None): 0.04, ("k8s", "x"): 0.04,
        ("gcp", "nowhere"): 0.01, ("odd", "y"): 0.05,
    }


def test_approvals(spark):
    req = spark.createDataFrame([("j", "p"), ("j", "q"), ("j", "r"), ("j", "s")], "job_name string, plan_hash string")
    app = spark.createDataFrame(
        [("j", "p", "ann", "2024-01-01T00:00:00Z"), ("j", "p", "bob", "2024-01-01T00:30:00Z"), ("j", "q", "ann", "2024-01-01T00:00:00Z"), ("j", "r", "ann", "soon")],
        "job_name string, plan_hash string, approver string, approved_at string",
    )
    got = L.valid_approval(req, app, F.lit("2024-01-01 01:30:00"))
    assert rows(got.select("plan_hash", "approved", "approver")) == [
        ("p", True, "bob"), ("q", False, None), ("r", True, "ann"), ("s", False, None),
    ]


def test_lineage(spark):
    b = spark.createDataFrame(
        [("j", c, p, r, e) for c, p, r, e in [("c", "p", "r", "e"), ("x", "p", "r", "e"), ("c", "x", "r", "e"), ("c", "p", "x", "e"), ("c", "p", "r", "x"), ("c", "p", "r", "e2"), ("c", "p", "r", "e3")]],
        "job_name string, contract_hash string, plan_hash string, intelligence_hash string, policy_eval_hash string",
    )

    def one(col, *vals):
        return spark.createDataFrame([("j", v) for v in vals], f"job_name string, {col} string")

    ev = spark.createDataFrame(
        [("j", "e", "c", "p", "r", "ALLOW"), ("j", "e2", "c", "other", "r", "ALLOW"), ("j", "e3", "c", "p", "r", "BLOCK")],
        "job_name string, policy_eval_hash string, contract_hash string, plan_hash string, intelligence_hash string, decision string",
    )
    got = L.lineage_check(b, one("contract_hash", "c"), one("plan_hash", "p"), one("intelligence_hash", "r"), ev)
    found = {(r.contract_hash, r.plan_hash, r.intelligence_hash, r.policy_eval_hash): r.failure for r in got.collect()}
    assert found == {
        ("c", "p", "r", "e"): None,
        ("x", "p", "r", "e"): "Invalid contract hash",
        ("c", "x", "r", "e"): "Invalid plan hash",
        ("c", "p", "x", "e"): "Invalid intelligence hash",
        ("c", "p", "r", "x"): "Invalid policy evaluation hash",
        ("c", "p", "r", "e2"): "Policy evaluation does not match plan hash",
        ("c", "p", "r", "e3"): "Build blocked by policy",
    }


def test_paths_and_graph(spark):
    df = spark.createDataFrame([("srv/api/x",), ("srv/rules/y",), ("other",)], "path string")
    got = L.classify_paths(df, {"api": ["/api/"], "policy": ["/rules/"], "srv": ["srv/"]})
    assert rows(got.select("path", "area", "severity")) == [
        ("srv/api/x", "api", "medium"), ("srv/api/x", "srv", "low"),
        ("srv/rules/y", "policy", "high"), ("srv/rules/y", "srv", "low"),
    ]
    assert rows(L.impact_summary(got).select("area", "files")) == [("api", 1), ("policy", 1), ("srv", 2)]
    f = spark.createDataFrame(
        [(1, "p", "j", "c1", "warn", "m", "a", ["b", None, "a"]), (2, "p", "j", "c1", "block", "m", None, None), (3, "p", "j", None, None, None, None, None)],
        "seq int, plan_id string, job_name string, code string, severity string, message string, path string, files array<string>",
    )
    nodes = G.impact_nodes(f)
    assert rows(nodes.select("id", "severity")) == [
        ("finding:advisor.finding:", "warn"), ("finding:c1:m", "warn"), ("path:a", None), ("path:b", None), ("plan:p", None),
    ]
    assert rows(G.impact_edges(f).select("from", "to", "type")) == [
        ("finding:c1:m", "path:a", "touches"), ("finding:c1:m", "path:b", "touches"),
        ("plan:p", "finding:advisor.finding:", "has_finding"), ("plan:p", "finding:c1:m", "has_finding"),
        ("plan:p", "finding:c1:m", "has_finding"),
    ]


def test_impact_nodes_ship_their_key_and_attributes_once(spark):
    f = spark.range(4000).select(
        F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id") % 3).alias("plan_id"), F.lit("j").alias("job_name"),
        F.lit("c").alias("code"), F.lit("warn").alias("severity"), F.sha2(F.col("id").cast("string"), 512).alias("message"),
        F.sha2((F.col("id") % 900).cast("string"), 256).alias("path"),
    )
    nodes = G.impact_nodes(f)
    assert nodes.groupBy("kind").count().orderBy("kind").collect() == [("finding", 4000), ("path", 900), ("plan", 3)]
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    # the rows that travel hold no id, which is made of kind and key
    assert "min_by" not in plan and "Generate explode" in plan
    # a NULL plan is a node too, and a smaller position wins over a smaller text
    null = spark.createDataFrame(
        [(2, None, "a", "c", "info", "m", None), (1, None, "b", "c", "warn", "m", None), (None, None, None, "c", None, "m", "x")],
        "seq int, plan_id string, job_name string, code string, severity string, message string, path string",
    )
    assert rows(G.impact_nodes(null)) == [
        (None, None, "plan", None, None, None, None, None),
        (None, "finding:c:m", "finding", "c:m", None, "c", "warn", "m"),
        (None, "path:x", "path", "x", None, None, None, None),
    ]


def test_ordered(spark):
    e = spark.createDataFrame(
        [("j", 1, "DRAFT", "h"), ("j", 2, "PLAN_READY", "h"), ("j", 3, "RUNNING", "i"), ("j", 4, "RUNNING", "i"), ("k", 1, "FAILED", None), ("k", 2, "RUNNING", None), ("k", 3, "RUNNING", "z")],
        "job_name string, seq int, state string, spec_hash string",
    )
    got = O.check_transitions(e, order=["seq"])
    assert rows(got.select("job_name", "seq", "legal")) == [
        ("j", 1, True), ("j", 2, True), ("j", 3, False), ("j", 4, True), ("k", 1, True), ("k", 2, False), ("k", 3, True),
    ]
    r = O.needs_rebuild(e)
    assert rows(r.select("job_name", "seq", "rebuild")) == [
        ("j", 1, True), ("j", 2, False), ("j", 3, True), ("j", 4, False), ("k", 1, True), ("k", 2, False), ("k", 3, True),
    ]
    assert rows(O.current_build(e).select("job_name", "seq")) == [("j", 4), ("k", 3)]
    assert rows(O.execution_history(e, order=["seq"]).select("job_name", "position")) == [
        ("j", 1), ("j", 2), ("j", 3), ("j", 4), ("k", 1), ("k", 2), ("k", 3),
    ]
    log = spark.range(10).select(F.col("id").alias("seq"), (F.col("id") % 2 == 0).alias("ok"))
    assert [x.seq for x in O.tail_events(log, 3, keep=F.col("ok")).collect()] == [8]
    assert [x.seq for x in O.tail_events(log, 0).collect()] == [9]
    assert [x.seq for x in O.newest_first(log).collect()][:2] == [9, 8]
    ex = spark.createDataFrame(
        [("2024-01-31 23:59:50", "2024-02-01 00:00:10", 1.5), ("2024-01-02", "2024-01-01", 1.0), ("2024-01-01", None, 2.0), (None, "2024-01-01", 2.0)],
        "s string, f string, estimated_cost_usd double",
    ).select(F.col("s").cast("timestamp").alias("submitted_ts"), F.col("f").cast("timestamp").alias("finished_ts"), "estimated_cost_usd")
    assert rows(O.execution_actuals(ex).select("month", "actual_runtime_seconds", "actual_cost_usd")) == [
        ("2024-01", None, 2.0), ("2024-01", 0.0, 1.0), ("2024-02", 20.0, 1.5),
    ]


def test_search(spark):
    q = spark.createDataFrame(
        [("t1", "c", 1, "OOM"), ("t2", "c", 2, "OOM"), ("t1", "c", 3, "stage oom oom x"), ("t1", "d", 4, "oom"), ("t1", "c", 5, ""),
         (None, "c", 6, "oom"), ("t1", "c", 7, None)],
        "tenant string, collection string, query_id int, query string",
    )
    d = spark.createDataFrame(
        [("t1", "c", "a", "OOM on stage 3", 1), ("t2", "c", "b", "network timeout", 2), ("t1", "c", "e", "oom again", 3), ("t1", "c", "f", "oom oom", 4),
         (None, "c", "g", "oom", 5), (None, None, "h", "oom", 6), ("t1", "c", "i", None, 0)],
        "tenant string, collection string, doc_id string, text string, seq int",
    )
    want = [(1, "a", 1.0), (1, "e", 1.0), (3, "a", 0.6667), (3, "e", 0.3333), (6, "g", 1.0)]
    assert rows(text_search(q, d, 2).select("query_id", "doc_id", "score")) == want
    # every word heavy, one row a cell: the same answer
    assert rows(text_search(q, d, 2, light_rows=0, cell_rows=1).select("query_id", "doc_id", "score")) == want
    assert text_search(q, d, 0).where("query_id = 1").count() == 1
    # a repeated document is a hit of its own, and rows of one query id share its places
    twice = text_search(q.unionByName(q), d.unionByName(d), 3).where("query_id = 1")
    assert [r.doc_id for r in twice.orderBy("seq").collect()] == ["a", "a", "a"]
    assert text_search(q.limit(0), d).count() == 0 and text_search(q, d.limit(0)).count() == 0


def _best_by_hand(queries, docs, k):
    out = []
    for qid, text in queries:
        words = set(text.split())
        found = [(-round(len(words & set(t.split())) / len(words), 4), did) for did, t in docs if words & set(t.split())]
        out += [(qid, did, -s) for s, did in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("light_rows", [1, 5, 15, 40, 10_000])
def test_search_equals_brute_force_at_every_weight(spark, light_rows):
    dice = random.Random(7)
    # common words, rare words, and a shared passage of rare words that lets light words alone decide
    def text(i):
        common = [f"c{dice.randrange(12)}" for _ in range(dice.randrange(1, 8))]
        rare = [f"r{dice.randrange(120)}" for _ in range(dice.randrange(0, 6))]
        return " ".join(common + rare + ([f"p{i % 5}x{j}" for j in range(15)] if i % 3 == 0 else []))

    docs = [(i, text(i)) for i in range(120)]
    queries = [(i, text(i)) for i in range(40)]
    scope = [F.lit("t").alias("tenant"), F.lit("c").alias("collection")]
    d = spark.createDataFrame(docs, "doc_id int, text string").select(*scope, "*", F.col("doc_id").alias("seq"))
    q = spark.createDataFrame(queries, "query_id int, query string").select(*scope, "*")
    got = text_search(q, d, 4, light_rows=light_rows, cell_rows=7).select("query_id", "doc_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == sorted(_best_by_hand(queries, docs, 4))


@pytest.mark.parametrize("k", [1, 3])
def test_search_in_rounds_keeps_no_row_per_word(spark, monkeypatch, k):
    dice = random.Random(5)
    # short texts and long ones, so that rounds differ in the width of their lanes
    texts = [" ".join(f"w{int(dice.random() ** 2 * 900)}" for _ in range(300 if i % 9 == 0 else dice.randrange(1, 40))) for i in range(150)]
    docs = list(enumerate(texts))
    scope = [F.lit("t").alias("tenant"), F.lit("c").alias("collection")]
    d = spark.createDataFrame(docs, "doc_id int, text string").select(*scope, "*", F.col("doc_id").alias("seq"))
    q = spark.createDataFrame(docs, "query_id int, query string").select(*scope, "*")
    sizes, plain = [], search.cut

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(search, "cut", counted)
    for name, value in (("ROUND_WORDS", 2500), ("TASK_WORDS", 1500), ("LONGEST", 5)):
        monkeypatch.setattr(search, name, value, raising=False)
    got = text_search(q, d, k, light_rows=2, cell_rows=10).select("query_id", "doc_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == sorted(_best_by_hand(docs, docs, k))
    # words stay in the row of their text; a row for each of the words took more disk than there was
    assert max(sizes) <= k * len(docs)


def test_search_counts_of_one_score_tie(spark):
    words = [f"w{i}" for i in range(30_000)]
    docs = [("t", "c", 1, " ".join(words[:15_000]), 1), ("t", "c", 2, " ".join(words[:15_001]), 2)]
    d = spark.createDataFrame(docs, "tenant string, collection string, doc_id int, text string, seq int")
    q = spark.createDataFrame([("t", "c", 9, " ".join(words))], "tenant string, collection string, query_id int, query string")
    # 15000 and 15001 of 30000 words are both 0.5, so the place decides
    assert rows(text_search(q, d, 1, light_rows=0).select("query_id", "doc_id", "score")) == [(9, 1, 0.5)]


def test_latest_files(spark):
    files = spark.createDataFrame(
        [("a", "2024-01-01"), ("b", "2024-01-03"), ("c", "2024-01-03"), ("d", "2024-01-02")], "file_name string, d string"
    ).select("file_name", F.col("d").cast("timestamp").alias("modified_at"))
    assert [r.file_name for r in O.latest_files(files, 3).collect()] == ["b", "c", "d"]
    assert O.latest_files(files, 0).count() == 1


@pytest.mark.parametrize("chunk_rows", [10, 10_000])
def test_hot_jobs_match_plain_windows(spark, chunk_rows):
    from pyspark.sql import Window

    states = F.array(*[F.lit(s) for s in ("DRAFT", "PLAN_READY", "PRECHECK_PASSED", "APPLIED", "RUNNING")])
    e = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("j"), F.col("id") % 20)).alias("job_name"),
        F.col("id").alias("seq"),
        F.get(states, F.col("id").cast("int") % 5).alias("state"),
    )
    w = Window.partitionBy("job_name").orderBy("seq")
    got = O.check_transitions(e, order=["seq"], chunk_rows=chunk_rows)
    want = e.select("seq", F.lag("state").over(w).alias("previous_state"))
    assert rows(got.select("seq", "previous_state")) == rows(want)
    legal = want.join(e, "seq").select("seq", F.coalesce(O.transition_legal("previous_state", "state"), F.lit(True)).alias("legal"))
    assert rows(got.select("seq", "legal")) == rows(legal)


def test_every_sync_gets_an_action(spark):
    items = spark.createDataFrame(
        [(1, "safe_auto"), (1, "manual"), (1, None), (2, "safe_auto"), (9, "manual"), (None, "manual")], "sync int, apply_mode string"
    )
    syncs = spark.createDataFrame(
        [(1, "diverged"), (2, "workspace_behind_linear"), (3, "workspace_ahead_linear"), (4, "unrelated_histories"), (5, "equal"), (None, None)],
        "sync int, topology string",
    )
    got = {r.sync: tuple(r)[2:] for r in R.sync_summaries(items, syncs).collect()}
    assert got == {
        1: (3, 1, 2, "manual_resolution_required"),
        2: (1, 1, 0, "safe_auto_apply_possible"),
        3: (0, 0, 0, "workspace_ahead_review_then_apply"),
        4: (0, 0, 0, "reset_or_rebaseline_required"),
        5: (0, 0, 0, "manual_review"),
        None: (1, 0, 1, "manual_review"),
    }


def test_a_release_needs_its_archive_and_its_files(spark):
    checks = spark.createDataFrame(
        [("a", "ok"), ("a", "extra"), ("b", "ok"), ("b", "missing"), ("c", "mismatched"), ("d", "ok"), ("e", "unchecked")], "release string, status string"
    )
    releases = spark.createDataFrame(
        [("a", "h", "h"), ("b", "h", "h"), ("c", None, "h"), ("d", "h", "x"), ("e", None, "h"), ("f", "h", "h"), ("g", "h", None)],
        "release string, expected_sha256 string, actual_sha256 string",
    )
    got = {r.release: (r.sha256_match, r.manifest_ok, r.ok) for r in R.verify_releases(checks, releases).collect()}
    t, f = True, False
    assert got == {"a": (t, t, t), "b": (t, f, f), "c": (t, f, f), "d": (f, t, f), "e": (t, t, t), "f": (t, f, f), "g": (f, f, f)}
    strict = R.verify_releases(checks, releases, strict_no_extras=True)
    assert {r.release for r in strict.where("ok").collect()} == {"e"}
