from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowtally.operators.admission import admitted_entries, budget_admission
from flowtally.operators.lifecycle import apply_commands, reconcile_stale_runs
from flowtally.operators.ratelimit import rate_limit
from tests.conftest import rows

RUN = "run_id string, status string, created_ts timestamp, updated_ts timestamp, cancel_requested boolean, terminal_reason string, retry_count int"


def test_stale_runs(spark):
    t = datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("a", "RUNNING", t, t, False, None, 0), ("b", "CANCELING", t, t, True, None, 0), ("c", "SUCCEEDED", t, t, False, None, 0), ("d", "PENDING", t, t + timedelta(minutes=5), False, None, 0)],
        RUN,
    )
    got = reconcile_stale_runs(runs, "2024-01-01 00:10:00", 300)
    assert rows(got.select("run_id", "status", "terminal_reason")) == [
        ("a", "FAILED", "stale_run_reconciled"), ("b", "CANCELED", "stale_cancel_reconciled"),
        ("c", "SUCCEEDED", None), ("d", "PENDING", None),
    ]


def _fold_commands(status, commands):
    retry, errors, asked = 0, 0, False
    for c in commands:
        if c == "cancel" and status not in ("SUCCEEDED", "FAILED", "CANCELED"):
            status, asked = "CANCELING", True
        elif c == "retry":
            if status in ("FAILED", "CANCELED"):
                status, retry, asked = "PENDING", retry + 1, False
            elif status == "SUCCEEDED":
                errors += 1
    return status, retry, asked, errors


def test_commands_match_a_fold(spark):
    rnd = random.Random(3)
    runs, commands, want, seq = [], [], [], 0
    t = datetime(2024, 1, 1)
    for i in range(200):
        status = rnd.choice(["PENDING", "RUNNING", "CANCELING", "SUCCEEDED", "FAILED", "CANCELED"])
        todo = [rnd.choice(["cancel", "retry"]) for _ in range(rnd.randrange(5))]
        runs.append((f"r{i}", status, t, t, False, "x", 0))
        for c in todo:
            seq += 1
            commands.append((f"r{i}", c, seq, t + timedelta(seconds=seq)))
        want.append((f"r{i}", *_fold_commands(status, todo)))
    got = apply_commands(
        spark.createDataFrame(runs, RUN),
        spark.createDataFrame(commands, "run_id string, command string, seq int, ts timestamp"),
    )
    assert rows(got.select("run_id", "status", "retry_count", "cancel_requested", "errors")) == sorted(want)


def _fold_rate(events, rpm, window):
    start, count, out = {}, {}, []
    for key, ts, i in sorted(events, key=lambda e: (e[1], e[2])):
        if key not in start or ts - start[key] >= window:
            start[key], count[key] = ts, 0
        count[key] += 1
        out.append((i, start[key], count[key], count[key] > rpm))
    return sorted(out)


@pytest.mark.parametrize("min_rows,gap", [(10_000, 4), (60, 4), (60, 1), (25, 90)])
def test_rate_limit_matches_a_fold(spark, min_rows, gap):
    rnd = random.Random(gap * 7 + min_rows)
    events, now = [], 0
    for i in range(1500):
        now += rnd.randrange(2 * gap)
        # key "hot" has two thirds of the rows; "beat" is strictly periodic
        key = "hot" if i % 3 else rnd.choice(["a", "b", "beat"])
        events.append((key, (i * 7) if key == "beat" else now, i))
    df = spark.createDataFrame(events, "k string, s int, i int").select(
        "k", F.timestamp_seconds("s").alias("ts"), "i", F.lit("post").alias("m")
    )
    got = rate_limit(df, "k", "ts", ["i"], rpm=6, method="m", min_rows=min_rows)
    found = sorted((r.i, r.s, r.window_count, r.over_limit) for r in got.select("i", F.unix_seconds("window_start").alias("s"), "window_count", "over_limit").collect())
    assert found == _fold_rate(events, 6, 60)
    assert rate_limit(df.withColumn("m", F.lit("GET")), "k", "ts", ["i"], method="m").count() == 0


def _fold_budget(requests, limits, ledger):
    spent, est, out = {}, {}, []
    for tenant, month, entry, cost in ledger:
        spent[tenant, month] = spent.get((tenant, month), 0) + cost
        est[tenant, month, entry] = cost
    for tenant, month, entry, cost, seq, refused in sorted(requests, key=lambda r: r[4]):
        limit, s, c = limits.get(tenant, 250), spent.get((tenant, month), 0), cost or 0
        if refused or s >= limit or s + c > limit:
            decision = "BLOCK"
        else:
            decision = "WARN" if limit > 0 and (s + c) / limit >= 0.8 else "ALLOW"
            if cost is not None:
                spent[tenant, month] = s + cost - est.get((tenant, month, entry), 0)
                est[tenant, month, entry] = cost
        out.append((seq, decision))
    return sorted(out)


@pytest.mark.parametrize("repeat,min_rows,seed", [(10_000, 10_000, 1), (40, 10_000, 2), (40, 50, 3), (8, 50, 4)])
def test_admission_matches_a_fold(spark, repeat, min_rows, seed):
    rnd = random.Random(seed)
    requests = [
        (
            rnd.choice(["hot", "hot", "a", "b"]),
            rnd.choice(["2024-01", "2024-02"]),
            f"e{rnd.randrange(repeat)}",
            None if rnd.random() < 0.05 else float(rnd.choice([0, 1, 2, 5, 20, 60])),
            i,
            rnd.random() < 0.1,
        )
        for i in range(600)
    ]
    limits = {"hot": 400.0, "a": 100.0}
    ledger = [("hot", "2024-01", "e1", 30.0), ("a", "2024-02", "e9", 10.0), ("b", "2024-02", "z", 5.0)]
    got = budget_admission(
        spark.createDataFrame(requests, "tenant string, month string, entry_id string, estimated_cost_usd double, seq int, refused boolean"),
        spark.createDataFrame(list(limits.items()), "tenant string, limit_usd double"),
        spark.createDataFrame(ledger, "tenant string, month string, entry_id string, estimated_cost_usd double"),
        blocked="refused",
        rounds=2,
        min_rows=min_rows,
    )
    assert rows(got.select("seq", "decision")) == rows(
        spark.createDataFrame(_fold_budget(requests, limits, ledger), "seq int, decision string")
    )


def test_admission_examples(spark):
    schema = "tenant string, month string, entry_id string, estimated_cost_usd double, seq int"
    two = spark.createDataFrame([("t", "m", "a", 10.0, 1), ("t", "m", "b", 10.0, 2)], schema)
    limit = spark.createDataFrame([("t", 15.0)], "tenant string, limit_usd double")
    got = budget_admission(two, limit)
    assert rows(got.select("seq", "decision")) == [(1, "ALLOW"), (2, "BLOCK")]
    assert rows(admitted_entries(got)) == [("t", "m", "a", 10.0)]
    near = spark.createDataFrame([("t", "m", "a", 79.0, 1), ("t", "m", "b", 1.0, 2)], schema)
    hundred = spark.createDataFrame([("t", 100.0)], "tenant string, limit_usd double")
    assert rows(budget_admission(near, hundred).select("seq", "decision")) == [(1, "ALLOW"), (2, "WARN")]
