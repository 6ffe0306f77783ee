from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from flowtally import functions as fn
from tests.conftest import rows


def _one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_hashes(spark):
    df = spark.createDataFrame([("a|", "b", None), ("a", "|b", ""), ("x", None, None)], "a string, b string, c string")
    got = df.select(fn.content_hash(["b", "a", "c"]).alias("h")).collect()
    assert got[0].h == hashlib.sha256(b'{"a":"a|","b":"b","c":null}').hexdigest()
    bars = [r.h for r in df.select(fn.change_hash(["a", "b"], compat=True).alias("h")).collect()]
    assert bars[0] == hashlib.md5(b"a||b").hexdigest() == bars[1] and bars[2] is None
    assert len({r.h for r in df.select(fn.change_hash(["a", "b"]).alias("h")).collect()}) == 3
    assert len(df.select(fn.content_hash(["a"], 16).alias("h")).first().h) == 16
    for bad in (fn.content_hash, fn.change_hash):
        with pytest.raises(ValueError):
            bad([])


def test_json_is_parsed_whole(spark):
    cases = {'{"a":1}': True, ' {"a":1} ': True, '{"a":1} x': False, '{"a":1}}': False, '{"a":1}]': False, '{"a":1},"b":2': False,
             '{"a":1},{"b":2}': False, "": False, "null": True, "[1]": True, "{'a':1}": False}
    df = spark.createDataFrame(list(cases.items()), "t string, ok boolean")
    assert df.where(fn.parse_json("t").isNotNull() != F.col("ok")).count() == 0


def test_json_diff(spark):
    df = spark.createDataFrame(
        [
            (1, '{"version": 1}', '{"version": 2}'),
            (2, '{"a":{"x":1,"y":[1,2]},"b":{"q":1}}', '{"a":{"x":2,"y":[1,2],"z":{"q":1}},"c":null}'),
            (3, "5", "6"), (4, "bad", "{}"), (5, '{"a":1}', "[1]"), (6, '{"a":null}', '{"a":1}'),
            (7, '{"b":1,"a":2}', '{"a":2, "b":1}'), (8, '{"a":{"b":{"c":1}}}', '{"a":{"b":{"c":2}}}'), (9, None, "{}"),
            (10, '{"l":[1,{"k":1}]}', '{"l":[1,{"k":2}]}'),
        ],
        "id int, x string, y string",
    )
    got = fn.json_diff(df, "x", "y")
    want = [
        (1, "version", "modified"), (2, "a.x", "modified"), (2, "a.z", "added"), (2, "b", "removed"), (2, "c", "added"),
        (3, "$", "modified"), (5, "$", "modified"), (6, "a", "modified"), (8, "a.b.c", "modified"), (10, "l", "modified"),
    ]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert rows(fn.json_diff(df.where("id = 8"), "x", "y", depth=3)) == [(8, "a.b.c", "modified")]
    with pytest.raises(Exception, match="deeper than depth"):
        fn.json_diff(df.where("id = 8"), "x", "y", depth=2).collect()
    numbers = spark.createDataFrame(
        [
            (1, '{"v": 1e2}', '{"v": 100}'),
            (2, '{"v": [1.50, [2, null]]}', '{"v": [1.5, [2.0, null]]}'),
            (3, '{"v": 12345678901234567890}', '{"v": 12345678901234567891}'),
            (4, '{"v": [1, null]}', '{"v": [1, 0]}'),
            (5, '{"v": "1.0"}', '{"v": "1"}'),
            (6, '[{"x":100}]', '[{"x":1e2}]'),
            (7, '[[[[{"x":[1.0, "a\\\\"1.0"]}]]]]', '[[[[{"x":[1, "a\\\\"1.0"]}]]]]'),
            (8, '[{"x":"1.0"}]', '[{"x":"1"}]'),
            (9, '[{"x":1,"y":2}]', '[{"y":2.0,"x":1}]'),
            (10, '[1, 2]', '[12]'),
            (11, '[9007199254740993]', '[9007199254740992]'),
            (12, '[]', '[null]'),
            (13, '[1e400]', '[true]'),
        ],
        "id int, x string, y string",
    )
    assert sorted(r.id for r in fn.json_diff(numbers, "x", "y").collect()) == [3, 4, 5, 8, 10, 11, 12, 13]
    assert rows(df.select("id", fn.json_parseable("x", "y").alias("ok")).where("not ok").select("id")) == [(4,), (9,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_requirement_text(spark):
    texts = [
        "read raw_db.t1",
        "job name: test_job env=qa read from raw_db.t1 write to curated_db.t2 partition by data_dt merge schedule: 0 6 * * * timezone: UTC pyspark",
        "pipeline: a__b schedule: 0 6 * * *",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in fn.extract_spec(df, "t").collect()}
    missing = ["job_name.missing", "env.missing", "schedule.missing", "source_table.missing", "target_table.missing"]
    assert got[0].warnings == got[3].warnings == missing and got[0].confidence == 0.5
    assert (got[1].job_name, got[1].env, got[1].warnings, got[1].confidence) == ("test_job", "qa", [], 1.0)
    assert (got[1].source_table, got[1].target_table, got[1].schedule) == ("raw_db.t1", "curated_db.t2", "0 6 * * *")
    # a schedule that ends the text in a star loses its stars
    assert got[2].job_name == "a_b" and "schedule.invalid" in got[2].warnings and "job_name.sanitized" in got[2].warnings
    own = fn.extract_spec(
        df, "t", defaults={"env": "PROD", "source_table": "a.b", "target_table": "bad", "language": "perl", "preset": "x", "schedule": "1 2 3"}
    ).where("i = 0").first()
    assert (own.env, own.source_table, own.target_table, own.schedule) == ("prod", "a.b", "curated_db.target_table", "0 6 * * *")
    assert own.warnings == ["preset.invalid", "job_name.missing", "language.invalid"]
    assert (got[1].description, got[1].tags, own.tags) == ("Generated from requirement", ["qa"], ["prod"])
    described = fn.extract_spec(df, "t", defaults={"description": " daily ", "tags": "a, ,b"}).where("i = 1").first()
    assert (described.description, described.tags) == ("daily", ["a", "b"])
    assert fn.extract_spec(df, "t", defaults={"description": "  ", "tags": ["x", 1]}).where("i = 1").first().tags == ["x", "1"]
    hinted = fn.extract_spec(df.withColumn("h", F.lit("my job")), "t", "h").where("i = 0").first()
    assert hinted.job_name == "my_job" and "job_name.sanitized" in hinted.warnings


def test_times_and_text(spark):
    iso = [fn.parse_iso_utc(F.lit(s)).cast("string") for s in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02", " 2024-01-02 03:04 ", "2024", "2024-13-01", "")]
    assert _one(spark, *iso) == ("2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 00:00:00", "2024-01-02 03:04:00", None, None, None)
    assert _one(spark, fn.token_count(F.lit("")), fn.token_count(F.lit(" a b  c\n")), fn.token_cost(F.lit(8), F.lit(12))) == (1, 3, 0.000032)
    assert _one(spark, fn.markdown_headers(F.lit("# a\r\n  ## b  \nx # c\n#d"))) == (["# a", "## b", "#d"],)
    assert _one(spark, fn.safe_identifier(F.lit("__a b__c!"), "job"), fn.safe_identifier(F.lit("!"), "job"), fn.safe_identifier(F.lit(" é x"), "task"), fn.safe_identifier(F.lit("a b")), fn.safe_identifier(F.lit("y" * 99), "task")) == (
        "a_b_c", "example_pipeline", "é_x", "a_b", "y" * 64)
    with pytest.raises(ValueError):
        fn.safe_identifier("x", "odd")


def test_paths_and_checks(spark):
    p = [fn.normalize_path(F.lit(s)) for s in ("/a/123/b", "", "/x/0123456789abcdef0", "/j/12345678-1234-1234-1234-123456789012", "/api/v2/modeling/m", "/api/v1/tenants/t/health")]
    assert _one(spark, *p) == ("/a/:id/b", "/", "/x/:hex", "/j/:uuid", "/api/v2/modeling/:name", "/api/v1/tenants/:tenant/health")
    g = [fn.glob_match(F.lit(s), ["**/*.pyc", "a?[!x]", "*.log"]) for s in ("x/y.pyc", "y.pyc", "abc", "abx", "l.log\n")]
    assert _one(spark, *g, fn.glob_match(F.lit("a"), [])) == (True, False, True, False, False, False)
    v = [fn.valid_cron(F.lit("0 6 * * *")), fn.valid_cron(F.lit(" 0 6 * *")), fn.valid_table(F.lit("a.b")), fn.valid_table(F.lit("a.b.c")), fn.valid_job_name(F.lit("a-b_1")), fn.valid_job_name(F.lit("a" * 129)), fn.valid_job_name(F.lit(None).cast("string"))]
    assert _one(spark, *v) == (True, False, True, False, True, False, False)
    s = [fn.scope_for_path(F.lit(x), ["jobs", "/dags/"]) for x in ("dags\\a", "jobs", "other")]
    assert _one(spark, *s) == ("dags", "jobs", "jobs")


def test_labels(spark):
    e = [fn.classify_error(F.lit(s)) for s in ("OOM on stage 3", "Out of Memory", "network timeout", "policy", "over budget", "corrupt block", "x")]
    assert _one(spark, *e) == ("OOM", "OOM", "network_timeout", "policy_violation", "quota_exceeded", "data_corruption", "unknown")
    r = [fn.normalize_risk(F.lit(x)) for x in (55, 0.4, 250, -1.0)]
    assert _one(spark, *r, fn.normalize_risk(F.lit(None).cast("double"))) == (0.55, 0.4, 1.0, 0.0, None)
    assert _one(spark, fn.explain_finding(F.lit("plan.no_baseline"), F.lit(None).cast("string"), F.lit("m"), F.lit(""))) == (
        "[info] plan.no_baseline | m | Guidance: No baseline commit/reference was found. Connect upstream or initialize baseline, then re-run.",)
    t = spark.createDataFrame([("OOM", "high", "0.9", "s", "a"), ("x", "y", "z", "", None), (None, None, "7", None, "")], "root_cause_class string, recurrence_risk string, confidence string, human_summary string, recommended_action string")
    assert [tuple(r) for r in fn.normalize_triage(t).collect()] == [
        ("OOM", "high", 0.9, "s", "a"),
        ("unknown", "medium", 0.55, "No summary provided.", "Investigate recent changes and retry."),
        ("unknown", "medium", 1.0, "No summary provided.", "Investigate recent changes and retry."),
    ]
    n = [fn.numeric_or_null(fn.parse_json(F.lit(s))) for s in ("1", "1.5", '"3"', "true", "null")]
    assert _one(spark, *n) == (1.0, 1.5, None, None, None)
