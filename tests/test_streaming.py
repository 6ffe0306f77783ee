from __future__ import annotations

import json
import os
import random
import tempfile
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from flowtally.operators.ratelimit import rate_limit
from flowtally.plans import cdc_apply, late_arrival_scd2
from flowtally.sources.records import json_objects
from flowtally.streaming import (
    read_cdc_table,
    read_scd2_history,
    stream_audit_counts,
    stream_budget_admission,
    stream_cdc_apply,
    stream_incremental_dedup,
    stream_late_scd2,
    stream_rate_limit,
    stream_request_commands,
    stream_stale_runs,
)
from tests.conftest import rows
from tests.test_folds import _fold_budget


def _folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _batches(spark, parts, schema):
    """A stream that reads one file per micro-batch, in order."""
    root = Path(_folder())
    for i, part in enumerate(parts):
        path = root / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps(r) for r in part), encoding="utf-8")
        stamp = 1_700_000_000 + i
        os.utime(path, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(root))


def _memory(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", _folder()).trigger(
        availableNow=True
    ).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def _foreach(df, write):
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", _folder()).trigger(availableNow=True).start()
    q.awaitTermination(240)


def test_audit_counts_stream_equals_batch(spark):
    schema = "ts_ms bigint, http struct<method:string,path:string,status:int>"
    lines = [[{"ts_ms": (m * 60 + s) * 1000, "http": {"method": "get", "path": "/a", "status": 200}} for s in range(m + 1)] for m in range(4)]
    src = _folder()
    for i, part in enumerate(lines):
        path = Path(src, f"{i}.jsonl")
        path.write_text("\n".join([*map(json.dumps, part), "oops", ""]))
        # batches go by the files' times, which may be equal otherwise
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = json_objects(spark.readStream.option("maxFilesPerTrigger", 1).text(src), schema)
    got = _memory(stream_audit_counts(stream, delay="0 seconds"), "audit_counts", "append")
    batch = stream_audit_counts(json_objects(spark.read.text(src), schema))
    # append mode holds back the window the watermark has not passed
    assert rows(got) == rows(batch)[:-1]
    assert [r.requests for r in batch.orderBy("window_start").collect()] == [1, 2, 3, 4]


def test_rate_limit_stream_equals_batch(spark):
    rnd = random.Random(1)
    now, parts = 0, []
    for b in range(4):
        part = []
        for _ in range(60):
            now += rnd.randrange(6)
            part.append({"k": rnd.choice("ab"), "s": now, "i": len(part) + b * 60, "m": rnd.choice(["POST", "GET"])})
        parts.append(part)
    schema = "k string, s bigint, i bigint, m string"
    shape = lambda d: d.select("k", "i", "m", F.timestamp_seconds("s").alias("ts"))
    got = _memory(stream_rate_limit(shape(_batches(spark, parts, schema)), "k", "ts", "i", 5, "m"), "limits", "append")
    flat = spark.createDataFrame([tuple(r.values()) for p in parts for r in p], schema)
    want = rate_limit(shape(flat), "k", "ts", ["i"], 5, "m")
    pick = ["window_start", "window_count", "over_limit"]
    assert rows(got.select("event_id", *pick)) == rows(want.select("i", *pick))


def _state_rows(df, mode, checkpoint):
    """Keys in the state after each micro-batch of one run."""
    q = df.writeStream.format("noop").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_rate_limit_stream_forgets_idle_keys(spark):
    parts = [
        [{"k": f"idle{i}", "s": 1 + i, "i": i} for i in range(20)] + [{"k": "back", "s": 5, "i": 20}],
        [{"k": "busy", "s": 500, "i": 21}],
        [{"k": "busy", "s": 501, "i": 22}, {"k": "back", "s": 502, "i": 23}],
    ]
    shape = _batches(spark, parts, "k string, s bigint, i bigint").select("k", "i", F.timestamp_seconds("s").alias("ts"))
    limited = stream_rate_limit(shape, "k", "ts", "i", 5, delay="30 seconds")
    kept = _state_rows(limited, "append", _folder())
    assert kept[0] == 21 and kept[-1] == 2
    got = _memory(limited, "limits_idle", "append")
    assert rows(got.where("key = 'back'").select("event_id", "window_count")) == [(20, 1), (23, 1)]


def test_commands_stream_forgets_ended_runs(spark):
    def c(run, command, seq, sec, status=None):
        return {"run_id": run, "command": command, "status": status, "seq": seq, "s": 1000 + sec}

    parts = [
        [c("done", "report", 1, 0, "SUCCEEDED"), c("live", "report", 2, 0, "RUNNING"), c("never", "cancel", 3, 0)],
        [c("new", "report", 4, 500, "RUNNING")],
        [c("new", "report", 5, 501, "RUNNING")],
        [c("done", "retry", 6, 502)],
    ]
    read = _batches(spark, parts, "run_id string, command string, status string, seq int, s bigint")
    stream = stream_request_commands(read.withColumn("at", F.timestamp_seconds("s")), "at", "10 seconds", 60)
    kept = _state_rows(stream, "update", _folder())
    # the ended run and the one never reported leave, active ones stay
    assert kept[0] == 3 and 2 in kept[1:]
    got = _memory(stream, "cmds_idle", "update")
    assert rows(got.where("run_id = 'done'").select("status", "errors")) == [(None, 1), ("SUCCEEDED", 0)]


def test_stale_runs_stream(spark):
    def beat(run, status, sec, asked=False):
        return {"run_id": run, "status": status, "updated_ts": (datetime(2024, 1, 1) + timedelta(seconds=sec)).isoformat() + "Z", "cancel_requested": asked}

    parts = [
        [beat("a", "RUNNING", 0), beat("b", "CANCELING", 0, True), beat("c", "RUNNING", 0), beat("d", "RUNNING", 0)],
        [beat("c", "SUCCEEDED", 10), beat("d", "RUNNING", 100)],
        [beat("e", "RUNNING", 130)],
        [beat("e", "RUNNING", 131)],
    ]
    schema = "run_id string, status string, updated_ts timestamp, cancel_requested boolean"
    got = _memory(stream_stale_runs(_batches(spark, parts, schema), 60), "stale", "append")
    assert rows(got.select("run_id", "status", "terminal_reason")) == [
        ("a", "FAILED", "stale_run_reconciled"), ("b", "CANCELED", "stale_cancel_reconciled"),
    ]


def test_commands_stream(spark):
    def c(run, command, seq, status=None):
        return {"run_id": run, "command": command, "status": status, "seq": seq}

    parts = [
        [c("a", "report", 1, "RUNNING"), c("a", "cancel", 2), c("b", "report", 3, "SUCCEEDED"), c("x", "cancel", 9)],
        [c("a", "cancel", 4), c("a", "report", 5, "CANCELED"), c("a", "retry", 6), c("a", "retry", 7), c("b", "retry", 8)],
    ]
    got = _memory(stream_request_commands(_batches(spark, parts, "run_id string, command string, status string, seq int")), "cmds", "update")
    assert set(rows(got)) >= {("a", "PENDING", False, 1, 0), ("b", "SUCCEEDED", False, 0, 1), ("x", None, False, 0, 1)}


def test_cdc_stream_equals_batch_and_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    parts = [
        [{"k": 1, "op": "U", "v": "A", "o": 1}, {"k": 1, "op": "U", "v": "AA", "o": 2}, {"k": 9, "op": "D", "o": 3}],
        [{"k": 1, "op": "D", "o": 4}, {"k": 4, "op": "I", "v": "d", "o": 5}],
    ]
    schema = "k int, op string, v string, o int"
    root = _folder()
    assert rows(read_cdc_table(spark, root, base, ["k"])) == rows(base)
    write = stream_cdc_apply(root, ["k"], ["o"])
    _foreach(_batches(spark, parts, schema), write)
    flat = spark.createDataFrame([(r["k"], r["op"], r.get("v"), r["o"]) for p in parts for r in p], schema)
    want = rows(cdc_apply(base, flat, ["k"], ["o"]))
    assert rows(read_cdc_table(spark, root, base, ["k"])) == want
    write(flat.where("o >= 4"), 1)
    assert rows(read_cdc_table(spark, root, base, ["k"])) == want


def test_incremental_dedup_stream(spark):
    parts = [[{"k": 1, "t": "2024-01-01T00:00:00Z"}, {"k": 1, "t": "2024-01-01T00:01:00Z"}], [{"k": 1, "t": "2024-01-01T00:02:00Z"}, {"k": 2, "t": "2024-01-01T00:02:00Z"}]]
    stream = _batches(spark, parts, "k int, t timestamp")
    assert rows(_memory(stream_incremental_dedup(stream, "t", ["k"]), "dedup", "append").select("k")) == [(1,), (2,)]
    again = _batches(spark, parts, "k int, t timestamp")
    assert _memory(stream_incremental_dedup(again, "t", ["k"], deduplicate=False), "nodedup", "append").count() == 4


def test_late_scd2_stream_equals_batch(spark):
    parts = [
        [{"id": 1, "d": "2024-01-01", "v": "a"}, {"id": 1, "d": "2024-03-01", "v": "c"}, {"id": 2, "d": "2024-01-01", "v": "z"}],
        [{"id": 1, "d": "2024-02-01", "v": "late"}],
    ]
    schema = "id int, d string, v string"
    shape = lambda d: d.select("id", F.col("d").cast("timestamp").alias("effective_dt"), "v")
    root = _folder()
    _foreach(shape(_batches(spark, parts, schema)), stream_late_scd2(root, ["id"]))
    flat = spark.createDataFrame([tuple(r.values()) for p in parts for r in p], schema)
    got = read_scd2_history(spark, root, ["id"])
    want = late_arrival_scd2(shape(flat), ["id"])
    assert rows(got.select(*want.columns)) == rows(want)


def test_admission_stream_equals_fold(spark):
    rnd = random.Random(5)
    requests = [(rnd.choice("ab"), "2024-01", f"e{rnd.randrange(30)}", float(rnd.choice([1, 5, 20])), i, False) for i in range(120)]
    names = ["tenant", "month", "entry_id", "estimated_cost_usd", "seq", "refused"]
    parts = [[dict(zip(names, r, strict=True)) for r in requests[i : i + 40]] for i in range(0, 120, 40)]
    schema = "tenant string, month string, entry_id string, estimated_cost_usd double, seq int, refused boolean"
    budgets = spark.createDataFrame([("a", 150.0), ("b", 80.0)], "tenant string, limit_usd double")
    root = _folder()
    _foreach(_batches(spark, parts, schema), stream_budget_admission(root, budgets))
    got = spark.read.parquet(f"{root}/decisions").select("seq", "decision")
    want = spark.createDataFrame(_fold_budget(requests, {"a": 150.0, "b": 80.0}, []), "seq int, decision string")
    assert rows(got) == rows(want)
