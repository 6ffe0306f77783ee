"""Ordered per-key operators that do not put a hot key into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends all rows of a key to one
task.  ``lag``, ``lead``, running sums and positions therefore ask first
whether a key may hold more than ``chunk_rows`` rows.  If none does, the plain
window is the plan.  Otherwise the table is cut by range along (keys, order):
windows run per (chunk, key), and what has to cross a border travels in a table
of one row per chunk at most.  Nothing is collected but the samples from which
Spark takes its borders, and the size of a chunk does not depend on the size of
the table until there are ``MOST_CHUNKS`` of them.

``hot_keys`` and ``with_chunk`` cut hot keys alone, along one order column; the
chains of the rate limit and the rounds of budget admission use them.  There a
hot key is one with more than 1/``parts`` of all rows, so at most ``parts``
keys reach the driver, and rows that share a value stay together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtally.lineage import cut

# most rows of a key that one task may get
CHUNK_ROWS = 1_000_000
# about how many rows a task of a window gets; Spark goes by compressed bytes, of which repetitive rows have few
TASK_ROWS = 250_000
# most chunks of a table: Spark samples borders on the driver, as many rows as there are chunks times a constant
MOST_CHUNKS = 1000
# counters of the heavy-hitter sketch
TRACKED = 10_000
PARTS = 1000
MIN_ROWS = 10_000
# as min_rows: the caller knows that no key is hot, so only rows are counted
NEVER = 2**62

CHUNK = "__chunk"
HOT = "__hot"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _ordinal(df: DataFrame, name: str) -> Column:
    """Order column as a bigint that sorts the same way."""
    kind = df.schema[name].dataType
    if isinstance(kind, _INTEGRAL):
        return F.col(name).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("bigint")
    raise ValueError(f"first order column {name!r} must be integral, a date or a timestamp, not {kind.simpleString()}")


def _same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    min_rows: int = MIN_ROWS,
    parts: int = PARTS,
) -> DataFrame | None:
    """Keys with more than max(``min_rows``, 1/``parts``) of the rows, with chunk borders; None if none."""
    if min_rows >= NEVER:
        return None
    point = _ordinal(df, order)
    seen = Observation()
    counted = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), F.min(point).alias("__lo"))
        .observe(seen, F.sum("__n").alias("total"))
    )
    largest = counted.where(F.col("__n") > int(min_rows)).orderBy(F.col("__n").desc()).limit(int(parts)).collect()
    if not largest:
        return None
    floor = max(int(min_rows), seen.get["total"] // int(parts))
    names = [f"__carry_key{i}" for i in range(len(keys))]
    fields = [T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys, strict=True)]
    # (key, number of chunks)
    hot = [(*row[:-2], -(-row[-2] // floor)) for row in largest if row[-2] > floor and row[-1] is not None]
    if not hot:
        return None
    session = df.sparkSession
    wanted = session.createDataFrame(hot, T.StructType([*fields, T.StructField("__chunks", T.LongType())]))
    most = max(row[-1] for row in hot)
    quantiles = F.percentile_approx(point, [i / most for i in range(1, most)], 10_000)
    found = (
        df.join(F.broadcast(wanted), _same_keys(keys, names))
        .groupBy(*names)
        .agg(F.max("__chunks").alias("__chunks"), quantiles.alias("__q"))
        .collect()
    )
    rows = []
    for *key, chunks, values in found:
        picked = [values[i * most // chunks - 1] for i in range(1, chunks)]
        rows.append((*key, sorted(set(picked))))
    return session.createDataFrame(rows, T.StructType([*fields, T.StructField("__borders", T.ArrayType(T.LongType()))]))


def with_chunk(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    min_rows: int = MIN_ROWS,
    parts: int = PARTS,
) -> DataFrame | None:
    """Add ``__chunk`` (monotone in ``order`` within a key) and ``__hot``; None if no key is hot."""
    hot = hot_keys(df, keys, order, min_rows=min_rows, parts=parts)
    if hot is None:
        return None
    names = [f"__carry_key{i}" for i in range(len(keys))]
    joined = df.withColumn("__point", _ordinal(df, order)).join(F.broadcast(hot), _same_keys(keys, names), "left")
    # borders at or below the row; a NULL lies below all
    chunk = F.size(F.filter("__borders", lambda b: b <= F.col("__point"))).cast("bigint")
    return (
        joined.withColumn(HOT, F.col("__borders").isNotNull())
        .withColumn(CHUNK, F.when(F.col(HOT), chunk).otherwise(F.lit(0).cast("bigint")))
        .drop("__point", "__borders", *names)
    )


def may_have_hot_key(df: DataFrame, keys: Sequence[str], chunk_rows: int) -> tuple[bool, int]:
    """Whether some key may hold more than ``chunk_rows`` rows, and the number of rows.

    One pass fills a mergeable heavy-hitter sketch of bounded size.  Its count
    of the heaviest key is an upper bound, and no other key holds more than the
    sketch can overlook.  Where that is too coarse to tell, keys are counted.
    False is proven; True may be a false alarm, which costs time only.
    """
    if chunk_rows >= NEVER:
        return False, df.count()
    hashed = F.xxhash64(*keys)
    # the function is there in SQL only
    top = F.call_function("approx_top_k", hashed, F.lit(1), F.lit(TRACKED))
    rows, found = df.agg(F.count(F.lit(1)), top).first()
    if rows <= chunk_rows:
        return False, rows
    if found and found[0]["count"] > chunk_rows:
        return True, rows
    # the sketch keeps at least TRACKED counters and overlooks 3.5 rows in so many; twice that shows without being listed
    if 7 * rows <= chunk_rows * TRACKED:
        return False, rows
    most = df.groupBy(hashed.alias("k")).count().agg(F.max("count")).first()[0]
    return most > chunk_rows, rows


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int, rows: int) -> DataFrame:
    """``df`` cut along (keys, order) into chunks of about half of ``chunk_rows`` rows, numbered in ``__chunk``.

    Cuts go through all columns, so rows of one key and one time are cut too.
    The number of chunks grows with the table, and the size of a chunk does not,
    up to ``MOST_CHUNKS`` chunks; beyond that chunks grow instead, because borders
    are sampled on the driver and every chunk is a task.
    Spark samples the borders while the plan runs, so the result is
    checkpointed: every later step, and any repeated task, sees the same chunks.
    """
    parts = min(max(2, -(-2 * rows // chunk_rows)), MOST_CHUNKS)
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    return cut(df.repartitionByRange(parts, *by).withColumn(CHUNK, F.spark_partition_id()))


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``rows`` need; a table small enough for one is left to Spark."""
    return df if rows <= TASK_ROWS else df.repartition(-(-rows // TASK_ROWS), *keys)


def _border_rows(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the first and the last key of each chunk; only these keys can go on in another chunk."""
    key = F.struct(*keys)
    ends = chunks.groupBy(CHUNK).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    found = chunks.join(ends, CHUNK).where(key.eqNullSafe(F.col("__lo")) | key.eqNullSafe(F.col("__hi")))
    return found.drop("__lo", "__hi")


def _carried(inner: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``inner`` with the row ``carry`` has for the chunk, and ``__same``: it is of the row's key.

    A chunk goes on with one key of the chunk before it at most, so the join
    is by chunk and adds no rows.
    """
    names = [f"__carry_key{i}" for i in range(len(keys))]
    side = carry.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    out = inner.join(side.withColumnRenamed(CHUNK, "__carry_chunk"), F.col(CHUNK) == F.col("__carry_chunk"), "left")
    same = F.col("__carry_chunk").isNotNull() & _same_keys(keys, names)
    return out.withColumn("__same", same).drop("__carry_chunk", *names)


def _shift(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], forward: bool, chunk_rows: int
) -> DataFrame:
    columns = df.columns
    by = [F.col(c).desc_nulls_last() if forward else F.col(c).asc_nulls_first() for c in order]
    hot, rows = may_have_hot_key(df, keys, chunk_rows)
    if not hot:
        plain = Window.partitionBy(*keys).orderBy(*by)
        dealt = _dealt(df, rows, *keys)
        return dealt.select(*columns, *[F.lag(source).over(plain).alias(name) for name, source in values.items()])
    chunks = range_chunks(df, keys, order, chunk_rows, rows)
    packed = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    inside = Window.partitionBy(CHUNK, *keys).orderBy(*by)
    inner = (_dealt(chunks, rows, CHUNK) if rows > TASK_ROWS else chunks.repartition(CHUNK)).withColumns(
        {"__near": F.lag(packed).over(inside), "__edge": F.row_number().over(inside) == 1}
    )
    pick = F.min_by if forward else F.max_by
    edges = _border_rows(chunks, keys).groupBy(*keys, CHUNK).agg(pick(packed, F.struct(*order)).alias("__tail"))
    between = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc() if forward else F.col(CHUNK).asc())
    carry = edges.select(*keys, CHUNK, F.lag("__tail").over(between).alias("__far")).where("__far IS NOT NULL")
    out = _carried(inner, carry, keys)
    use_far = F.col("__edge") & F.col("__same")
    return out.select(
        *columns,
        *[F.when(use_far, F.col(f"__far.{n}")).otherwise(F.col(f"__near.{n}")).alias(n) for n in values],
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], *, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``lag(source)`` as ``name`` for each ``name: source``; ``order`` must be total within a key."""
    return _shift(df, keys, order, values, False, chunk_rows)


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], *, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``lead(source)`` as ``name`` for each ``name: source``; ``order`` must be total within a key."""
    return _shift(df, keys, order, values, True, chunk_rows)


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str], *, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Inclusive running sums as ``name`` for each ``name: source``.

    Sources must be integral: integer sums do not depend on how rows are cut.
    """
    columns = df.columns
    asc = [F.col(c).asc_nulls_first() for c in order]
    zero = F.lit(0)
    hot, rows = may_have_hot_key(df, keys, chunk_rows)
    if not hot:
        plain = Window.partitionBy(*keys).orderBy(*asc).rowsBetween(Window.unboundedPreceding, 0)
        dealt = _dealt(df, rows, *keys)
        return dealt.select(*columns, *[F.coalesce(F.sum(source).over(plain), zero).alias(n) for n, source in sums.items()])
    chunks = range_chunks(df, keys, order, chunk_rows, rows)
    inside = Window.partitionBy(CHUNK, *keys).orderBy(*asc).rowsBetween(Window.unboundedPreceding, 0)
    inner = (_dealt(chunks, rows, CHUNK) if rows > TASK_ROWS else chunks.repartition(CHUNK)).withColumns(
        {f"__in_{n}": F.coalesce(F.sum(source).over(inside), zero) for n, source in sums.items()}
    )
    totals = _border_rows(chunks, keys).groupBy(*keys, CHUNK)
    totals = totals.agg(*[F.coalesce(F.sum(source), zero).alias(f"__sum_{n}") for n, source in sums.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, CHUNK, *[F.sum(f"__sum_{n}").over(before).alias(f"__off_{n}") for n in sums])
    carry = carry.where(" OR ".join(f"`__off_{n}` IS NOT NULL" for n in sums))
    out = _carried(inner, carry, keys)
    offset = {n: F.when(F.col("__same"), F.col(f"__off_{n}")).otherwise(zero) for n in sums}
    return out.select(*columns, *[(F.col(f"__in_{n}") + F.coalesce(offset[n], zero)).alias(n) for n in sums])


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", *, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """1-based position of each row within its key."""
    ones = df.withColumn("__one", F.lit(1).cast("bigint"))
    return with_running(ones, keys, order, {name: "__one"}, chunk_rows=chunk_rows).drop("__one")
