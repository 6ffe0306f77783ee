"""Cutting lineage where one result feeds several plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the session names in ``spark.checkpoint.dir``.

    A local session without that setting, as in tests, gets a folder of its own
    that goes when the process ends; a cluster must name one, because executors
    can be lost.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# from Spark 4.1 on: shuffle files go when the plan has run, instead of when the driver collects its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; shuffle files made on the way are removed, as nothing reads them again."""
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(shared_dir(session))
    before = session.conf.get(CLEANUP, None)
    session.conf.set(CLEANUP, "true")
    try:
        # the setting holds for plans made under it, so ``df`` itself keeps what it has shuffled
        return df.select("*").checkpoint(eager=True)
    finally:
        session.conf.unset(CLEANUP) if before is None else session.conf.set(CLEANUP, before)
