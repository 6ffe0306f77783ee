"""File manifests."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.functions.scalars import glob_match
from flowtally.lineage import cut

# Folders a runtime manifest leaves out
SKIPPED_FOLDERS = (
    "workspace",
    "node_modules",
    ".venv",
    "venv",
    "__pycache__",
    ".mypy_cache",
    ".pytest_cache",
    ".git",
    ".egg-info",
)


def _pruned(path: str, includes: Sequence[str], skip: frozenset[str]) -> bool:
    """Whether a folder can hold no wanted file, so that it is not listed."""
    if not skip.isdisjoint(path.split("/")):
        return True
    inside = [i for i in includes if path == i or path.startswith(i + "/") or i.startswith(path + "/")]
    return bool(includes) and not inside


def _list_tree(spark: SparkSession, base: str, wanted: Sequence[str], skip: frozenset[str]) -> DataFrame:
    """(path, size) of the wanted files below ``base``: the folders of one level are dealt to tasks, then those below them."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(base)
        top = top.rstrip("/")
        for batch in batches:
            for folder in batch["path"]:
                found = []
                for entry in store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/") or "/")):
                    path = entry.path[len(top) + 1 :]
                    if entry.type == fs.FileType.Directory:
                        if not _pruned(path, wanted, skip):
                            found.append((path, 0, True))
                    elif skip.isdisjoint(path.split("/")):
                        if not wanted or any(path == i or path.startswith(i + "/") for i in wanted):
                            found.append((path, entry.size, False))
                yield pd.DataFrame(found, columns=["path", "size", "folder"])

    tasks = spark.sparkContext.defaultParallelism
    folders = spark.range(1).select(F.lit("").alias("path"))
    levels: list[DataFrame] = []
    while not levels or not folders.isEmpty():
        dealt = folders.repartition(tasks, "path")
        levels.append(cut(dealt.mapInPandas(listed, "path string, size bigint, folder boolean")))
        folders = levels[-1].where("folder").select("path")
    return reduce(DataFrame.unionByName, levels).where("NOT folder").select("path", "size")


def file_manifest(
    spark: SparkSession,
    root: str,
    includes: Sequence[str] = (),
    excludes: Sequence[str] = (),
    skip_folders: Sequence[str] = (),
) -> DataFrame:
    """(path, sha256, size) of every file below ``root``, sorted by path; hidden and underscore names included.

    ``includes`` are files or folders relative to ``root`` (none means all),
    ``excludes`` are globs on the relative path, ``skip_folders`` are names
    that may not occur anywhere in the path.  Spark's own listing leaves out
    names that begin with ``_`` or ``.``, so tasks list the folders, one level
    of the tree after the other, and do not enter those that can hold no wanted
    file.  The tree is listed when this is called; the files that stay are
    dealt out and hashed as streams, whatever their size.  ``root`` is a path or URI
    of any file system that pyarrow opens; a relative one is resolved once.
    """
    base = root if "://" in root or root.startswith("/") else os.path.abspath(root)
    wanted = [i.strip("/") for i in dict.fromkeys(includes)]
    skip = frozenset(skip_folders)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            digests = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with store.open_input_stream(f"{top.rstrip('/')}/{path}", compression=None) as source:
                    while part := source.read(1 << 20):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "sha256": digests, "size": batch["size"]})

    files = _list_tree(spark, base, wanted, skip)
    if excludes:
        files = files.where(~glob_match("path", list(dict.fromkeys(excludes))))
    dealt = files.repartition(spark.sparkContext.defaultParallelism)
    return dealt.mapInPandas(hashed, "path string, sha256 string, size bigint").orderBy("path")
