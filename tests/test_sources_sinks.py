from __future__ import annotations

import hashlib
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowtally.sinks import (
    append_log,
    insert_if_absent,
    merge_upsert,
    publish_version,
    read_current,
    save_table,
    write_append,
    write_overwrite,
)
from flowtally.sources import file_manifest, read_json_dir, read_jsonl, read_overrides, read_table, read_wrapped_json
from flowtally.sources.files import SKIPPED_FOLDERS, _list_tree
from tests.conftest import rows


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def test_read_table_takes_names_and_paths(spark, sf_dir):
    read_table(spark, f"{sf_dir}/region.parquet").createOrReplaceTempView("region_v")
    assert read_table(spark, "region_v").count() == 5


def test_jsonl_skips_blank_broken_and_non_objects(spark, folder):
    path = folder / "log.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\noops\n[1]\n"s"\n  \n{"a": 3} x\n{"a": 4}}\n{"a": 5}]\n{"a": 2}\n', encoding="utf-8")
    got = read_jsonl(spark, str(path), "a int, b string").orderBy("seq")
    assert [(r.a, r.b) for r in got.collect()] == [(1, "x"), (2, None)]
    missing = read_jsonl(spark, str(folder / "none.jsonl"), "a int")
    assert missing.columns == ["a", "seq"] and missing.count() == 0


def test_wrapped_json(spark, folder):
    path = folder / "ledger.json"
    path.write_text(json.dumps({"kind": "ledger", "entries": [{"e": "a", "c": 1.5}, 7, {"e": "b", "c": "x"}]}))
    got = read_wrapped_json(spark, str(path), "e string, c double")
    # a string is no number, so c is NULL
    assert rows(got.select("e", "c")) == [("a", 1.5), ("b", None)]
    (folder / "bad.json").write_text("{oops")
    assert read_wrapped_json(spark, str(folder / "bad.json"), "e string").count() == 0
    assert read_wrapped_json(spark, str(folder / "none.json"), "e string").count() == 0
    (folder / "list.json").write_text('{"entries": 3}')
    assert read_wrapped_json(spark, str(folder / "list.json"), "e string").count() == 0


def test_json_dir(spark, folder):
    (folder / "d").mkdir()
    (folder / "d" / "a.json").write_text('{\n "x": 1\n}')
    (folder / "d" / "b.json").write_text("{bad")
    (folder / "d" / "c.txt").write_text('{"x": 3}')
    got = read_json_dir(spark, str(folder / "d"), "x int")
    assert [(r.x, r.file_name) for r in got.collect()] == [(1, "a.json")]
    assert got.where(F.col("modified_at").isNull()).count() == 0
    assert read_json_dir(spark, str(folder / "e"), "x int").count() == 0


def test_overrides(spark, folder):
    path = folder / "p.json"
    path.write_text('{"aws/us-east-1": 0.030, " K8S / Default ": "0.038", "nokey": 1, "a/b/c": 2, "x/y": "z"}')
    assert rows(read_overrides(spark, str(path))) == [
        ("a", "b/c", 2.0),
        ("aws", "us-east-1", 0.03),
        ("k8s", "default", 0.038),
    ]
    path.write_text("[1, 2]")
    assert read_overrides(spark, str(path)).count() == 0
    assert read_overrides(spark, str(folder / "none")).count() == 0


def test_manifest(spark, folder):
    root = folder / "m"
    for name, text in {"a.txt": "A", "src/b.py": "B", "src/c.pyc": "C", "src/node_modules/d.js": "D"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = file_manifest(spark, str(root), excludes=["*.pyc"], skip_folders=SKIPPED_FOLDERS).collect()
    assert [(r.path, r.sha256, r.size) for r in got] == [
        ("a.txt", hashlib.sha256(b"A").hexdigest(), 1),
        ("src/b.py", hashlib.sha256(b"B").hexdigest(), 1),
    ]
    assert [r.path for r in file_manifest(spark, str(root), includes=["src"]).collect()] == [
        "src/b.py",
        "src/c.pyc",
        "src/node_modules/d.js",
    ]


def test_overwrite_replaces_only_present_partitions(spark, folder):
    path = str(folder / "t")
    write_overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    write_overwrite(spark.createDataFrame([(9, "b"), (3, "c")], "v int, p string"), path, ["p"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (3, "c"), (9, "b")]


def test_table_writes_match_columns_by_name(spark):
    spark.sql("DROP TABLE IF EXISTS tw")
    save_table(spark.createDataFrame([(1, "a")], "v int, s string"), "tw")
    write_append(spark.createDataFrame([("b", 2)], "s string, v int"), "tw")
    assert rows(spark.table("tw")) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="columns"):
        write_append(spark.createDataFrame([("b",)], "s string"), "tw")
    with pytest.raises(ValueError):
        save_table(spark.range(1), "tw", "merge")


def test_merge(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert rows(merge_upsert(target, source, ["k"])) == rows(
        spark.createDataFrame([(1, "a"), (2, "B"), (3, "C"), (None, "n"), (None, "N")], "k int, v string")
    )
    twice = source.union(source)
    with pytest.raises(Exception, match="duplicate merge key"):
        merge_upsert(target, twice, ["k"]).collect()
    ordered = spark.createDataFrame([(2, "x", 1), (2, "y", 2)], "k int, v string, o int")
    got = merge_upsert(target.withColumn("o", F.lit(0)), ordered, ["k"], ["o"])
    assert rows(got.where("k = 2").select("v")) == [("y",)]


def test_insert_if_absent_and_log(spark, folder):
    target = spark.createDataFrame([("h1", 1)], "h string, v int")
    source = spark.createDataFrame([("h1", 1), ("h2", 2), ("h2", 2)], "h string, v int")
    new = insert_if_absent(target, source, "h")
    assert rows(new) == [("h2", 2)]
    append_log(new, str(folder / "log"))
    append_log(new, str(folder / "log"))
    assert rows(read_jsonl(spark, str(folder / "log"), "h string, v int", seq=None)) == [("h2", 2), ("h2", 2)]


def test_versions(spark, folder):
    root = str(folder / "v")
    assert read_current(spark, root) is None
    publish_version(spark.range(2), root, 1)
    publish_version(spark.range(5), root, 2)
    publish_version(spark.range(3), root, 2)
    assert read_current(spark, root).count() == 3


def test_file_manifest_has_hidden_names_and_nested_root_names(spark, tmp_path, monkeypatch):
    names = ["a.txt", "__init__.py", ".env", "_x/c.txt", "pkg/b.txt", "sub/pkg/b.txt", "node_modules/pkg/d.txt", "empty"]
    for name in names:
        (tmp_path / "pkg" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pkg" / name).write_text("" if name == "empty" else name)
    monkeypatch.chdir(tmp_path)
    for root in ("pkg", "pkg/", str(tmp_path / "pkg"), f"file://{tmp_path}/pkg"):
        assert [r.path for r in file_manifest(spark, root).collect()] == sorted(names)
    kept = [r.path for r in file_manifest(spark, "pkg", ["pkg", ".env", "sub/pkg"], ["*.env"], ["node_modules"]).collect()]
    assert kept == ["pkg/b.txt", "sub/pkg/b.txt"]
    got = {r.path: (r.sha256, r["size"]) for r in file_manifest(spark, "pkg").collect()}
    assert got["a.txt"] == (hashlib.sha256(b"a.txt").hexdigest(), 5)
    assert got["empty"] == (hashlib.sha256(b"").hexdigest(), 0)


def test_file_manifest_lists_folders_in_several_tasks(spark, tmp_path):
    names = [f"top{i}/in{j}/f{k}.txt" for i in range(6) for j in range(4) for k in range(3)] + ["top0/deep/er/still/x", "root.txt"]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "empty").mkdir()
    listed = _list_tree(spark, str(tmp_path), [], frozenset())
    assert sorted(r.path for r in listed.collect()) == sorted(names)
    assert listed.where("path LIKE '%/in%'").select(F.spark_partition_id()).distinct().count() > 1
    got = {r.path: (r.sha256, r["size"]) for r in file_manifest(spark, str(tmp_path)).collect()}
    assert got == {n: (hashlib.sha256(n.encode()).hexdigest(), len(n)) for n in names}
    assert file_manifest(spark, str(tmp_path / "empty")).count() == 0
