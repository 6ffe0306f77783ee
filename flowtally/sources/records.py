"""JSON record files: append logs, wrapped documents, one-document files, price overrides."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtally.functions.scalars import is_json_object, parse_json, strip


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _or_empty(read, spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An absent path reads as an empty frame."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_objects(lines: DataFrame, schema: T.StructType | str, column: str = "value") -> DataFrame:
    """Rows of ``column`` that hold one JSON object each, as columns of ``schema``.

    Blank lines, unparseable lines and values that are no object are left out.
    Works on a batch and on a stream.
    """
    others = [c for c in lines.columns if c != column]
    return (
        lines.where(is_json_object(parse_json(column)))
        .withColumn("__r", F.from_json(F.col(column), _schema(schema)))
        .select("__r.*", *others)
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, seq: str | None = "seq") -> DataFrame:
    """Append log, one JSON object per line.

    ``seq`` names a struct column (file time, file, split start, row in task)
    that sorts lines in file order.
    """
    order = F.struct(
        F.col("_metadata.file_modification_time").alias("written"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    target = _schema(schema)
    empty = T.StructType([*target.fields]) if not seq else target
    extra = [order.alias(seq)] if seq else []

    def read() -> DataFrame:
        return json_objects(spark.read.text(path).select("value", *extra), target)

    out = _or_empty(read, spark, empty)
    if seq and seq not in out.columns:
        kind = "struct<written:timestamp,file:string,block:bigint,row:bigint>"
        out = out.withColumn(seq, F.lit(None).cast(kind))
    return out


def read_wrapped_json(
    spark: SparkSession,
    path: str,
    entry_schema: T.StructType | str,
    array_field: str = "entries",
) -> DataFrame:
    """Entries of ``{"kind": ..., "<array_field>": [...]}``.

    A missing or corrupt file is empty, and entries that are no object are
    left out.  ``seq`` is the place of an entry in its list.
    """
    target = _schema(entry_schema)
    entries = "array<variant>"
    with_seq = T.StructType([*target.fields, T.StructField("seq", T.IntegerType())])

    def read() -> DataFrame:
        text = spark.read.text(path, wholetext=True)
        root = parse_json("value")
        listed = text.select(F.try_variant_get(root, f"$.{array_field}", entries).alias("__l"))
        item = listed.select(F.posexplode("__l").alias("seq", "__v"))
        return (
            item.where(is_json_object("__v"))
            .withColumn("__r", F.from_json(F.to_json(F.col("__v")), target))
            .select("__r.*", "seq")
        )

    return _or_empty(read, spark, with_seq)


def read_json_dir(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | str,
    glob: str = "*.json",
) -> DataFrame:
    """One JSON document per file, with ``file_name`` and ``modified_at``; bad files are left out."""
    target = _schema(schema)
    meta = [T.StructField("file_name", T.StringType()), T.StructField("modified_at", T.TimestampType())]

    def read() -> DataFrame:
        text = spark.read.text(directory, wholetext=True, pathGlobFilter=glob)
        return json_objects(
            text.select(
                "value",
                F.col("_metadata.file_name").alias("file_name"),
                F.col("_metadata.file_modification_time").alias("modified_at"),
            ),
            target,
        )

    return _or_empty(read, spark, T.StructType([*target.fields, *meta]))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Price overrides ``{"provider/region": price}`` as (provider, region, price).

    Keys are trimmed and lower-cased; keys without ``/`` and prices that are no
    number are left out.  A document that is no object gives no rows.
    """
    out_schema = T.StructType.fromDDL("provider string, region string, price double")

    def read() -> DataFrame:
        text = spark.read.text(path, wholetext=True)
        root = parse_json("value")
        pairs = text.where(is_json_object(root)).select(
            F.explode(F.try_variant_get(root, "$", "map<string,variant>")).alias("key", "__v")
        )
        part = F.split("key", "/", 2)
        price = F.expr("try_cast(try_variant_get(__v, '$', 'string') AS double)")
        # booleans cast to 1 and 0, as float() does
        flag = F.try_variant_get("__v", "$", "boolean").cast("double")
        is_flag = F.schema_of_variant("__v") == "BOOLEAN"
        return pairs.where(F.size(part) == 2).select(
            F.lower(strip(part[0])).alias("provider"),
            F.lower(strip(part[1])).alias("region"),
            F.when(is_flag, flag).otherwise(price).alias("price"),
        ).where(F.col("price").isNotNull())

    return _or_empty(read, spark, out_schema)
