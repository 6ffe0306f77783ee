from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from flowtally.lineage import CLEANUP, cut


def _shuffle_files(spark) -> set[Path]:
    context = spark.sparkContext._jsc.sc()
    folder = Path(context.env().blockManager().diskBlockManager().localDirsString()[0])
    return set(folder.rglob("shuffle_*.data"))


def test_cut_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    table = spark.range(1000).repartition(3)
    counts = cut(table.groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.time() + 20
    # the driver asks the block managers to remove them, and does not wait
    while _shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, None) in (setting, "false")
    assert counts.agg(F.sum("count")).first()[0] == 1000 and table.count() == 1000


def test_cut_keeps_what_the_frame_itself_shuffled(spark):
    table = spark.range(100).groupBy((F.col("id") % 5).alias("k")).count()
    assert table.count() == 5 and cut(table).count() == 5 and cut(table).count() == 5 and table.count() == 5
    twice = spark.range(3).selectExpr("id AS a", "id AS a")
    assert cut(twice).columns == ["a", "a"]
