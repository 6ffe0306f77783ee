"""Overwrite, append, merge, logs and versioned publishing.

Plain parquet has no MERGE, so merges return the new table as a DataFrame.
``publish_version`` writes it beside the old one and readers move on to the
newest complete version; a path that is being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _write(df: DataFrame, target: str, mode: str, partition_by: Sequence[str], fmt: str) -> None:
    writer = df.write.mode(mode).format(fmt)
    if mode == "overwrite" and partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if "/" in target:
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(target)
        return
    spark = df.sparkSession
    if spark.catalog.tableExists(target):
        # insertInto goes by position: put the columns into the table's order
        names = spark.table(target).columns
        missing, extra = set(names) - set(df.columns), set(df.columns) - set(names)
        if missing or extra:
            raise ValueError(f"columns of {target} differ: missing {sorted(missing)}, unknown {sorted(extra)}")
        insert = df.select(*names).write.mode(mode)
        if mode == "overwrite":
            insert = insert.option("partitionOverwriteMode", "dynamic")
        insert.insertInto(target, overwrite=mode == "overwrite")
        return
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(target)


def write_overwrite(df: DataFrame, target: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Replace the partitions present in ``df``; other partitions stay."""
    _write(df, target, "overwrite", partition_by, fmt)


def write_append(df: DataFrame, target: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Append rows; columns are matched by name."""
    _write(df, target, "append", partition_by, fmt)


def save_table(df: DataFrame, target: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Create ``target`` if it is missing, else overwrite it whole or append."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unsupported table mode {mode!r}")
    df.write.mode(mode).format(fmt).saveAsTable(target)


def append_log(df: DataFrame, path: str) -> None:
    """Append one JSON object per line."""
    df.write.mode("append").json(path)


def unique_source(source: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None) -> DataFrame:
    """One row per key.

    With ``order_by`` the last row wins.  Without it a second row for a key
    fails the job, as MERGE does.  Rows with a NULL in the key match nothing
    and all stay.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    others = [c for c in source.columns if c not in keys]
    packed = F.struct(*others) if others else F.lit(True)
    if order_by:
        last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order_by])
        kept = source.where(known).withColumn("__n", F.row_number().over(last)).where(F.col("__n") == 1).drop("__n")
    else:
        # partial aggregation keeps one row per key and task before the shuffle
        single = source.where(known).groupBy(*keys).agg(F.first(packed).alias("__r"), F.count(F.lit(1)).alias("__n"))
        text = "duplicate merge key in source; pass order_by to keep the last row"
        checked = single.where(F.when(F.col("__n") > 1, F.raise_error(F.lit(text)).cast("boolean")).otherwise(True))
        kept = checked.select(*keys, *([F.col("__r")[c].alias(c) for c in others]))
    return kept.select(*source.columns).unionByName(source.where(~known))


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The target after an upsert: matched rows replaced, new rows inserted, the rest kept."""
    new = unique_source(source, keys, order_by)
    # the bare keys do for the anti join; distinct keeps a repeated key from piling up
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(new.select(*target.columns))


def insert_if_absent(target: DataFrame, source: DataFrame, hash_col: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``source`` to append to a content-addressed ``target``; the first write of a hash wins.

    ``order_by`` says which row of ``source`` is the first; without it any row
    of a hash stands for all, which is right only if they are equal.  NULLs
    come last.  Rows beyond the first leave in each task before the shuffle.
    """
    if order_by:
        first = Window.partitionBy(hash_col).orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
        one = source.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n")
    else:
        one = source.dropDuplicates([hash_col])
    return one.join(target.select(hash_col), [hash_col], "left_anti").select(*source.columns)


def publish_version(df: DataFrame, root: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` as version N below ``root`` and then record N as committed.

    Running it again replaces version N only.
    """
    base = root.rstrip("/")
    path = f"{base}/data/version={int(version)}"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    mark = df.sparkSession.range(1).select(F.lit(int(version)).cast("bigint").alias("version"))
    mark.coalesce(1).write.mode("overwrite").json(f"{base}/commits/{int(version)}")
    return path


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest committed version number, or None."""
    try:
        marks = spark.read.schema("version bigint").option("recursiveFileLookup", True).json(f"{root.rstrip('/')}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.agg(F.max("version").alias("v")).first()["v"]


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest committed version, or None."""
    newest = current_version(spark, root)
    return None if newest is None else spark.read.parquet(f"{root.rstrip('/')}/data/version={newest}")
