"""Request rate limit with windows that open at the first request.

A window of a key opens at its first counted request and ends with the first
request that comes at least ``window`` later, which opens the next one.  The
windows of a key are a chain, so they depend on all earlier requests; clock
aligned windows would be a different limit.

A hot key is cut into chunks along time (see ``flowtally.skew``).  For each
chunk one pass finds, for every request that could open the chunk's first
window, where the chain stands at the end of the chunk.  Chains that meet stay
together, so these are few rows.  A second pass walks over them, one chunk
after the other, and so knows the open window each chunk starts with.  Then
all chunks are worked off side by side.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.skew import CHUNK, HOT, MIN_ROWS, PARTS, with_chunk

COUNTED_METHODS = ("POST", "PUT", "PATCH", "DELETE")
RPM = 120


def _runs(key: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches of equal (key, chunk) in sorted arrays."""
    if not len(chunk):
        return
    change = (chunk[1:] != chunk[:-1]) | (key[1:] != key[:-1])
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(chunk)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _chain_ends(window: int):
    """Per chunk: (newest opening request of a class, last window start), classes of merged chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, closed = None, 0, False
        # (window start, newest opener, last opener), by start.  Candidates keep
        # their cyclic order, so a class is a run of them; one that wraps around
        # holds the last candidate of all and the first few up to the newest.
        chains: deque = deque()
        out: list[tuple] = []

        def finish() -> None:
            if group is not None:
                for start, *openers in chains:
                    out.extend((*group, o, start) for o in openers if o is not None)

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(list(c), type=t) for c, t in zip(cols, types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "chunk", "opener", "last_start"])

        for batch in batches:
            key, chunk, times = _columns(batch, "key", "chunk", "t")
            for lo, hi in _runs(key, chunk):
                if group != (key[lo], chunk[lo]):
                    finish()
                    group, first, closed = (key[lo], chunk[lo]), int(times[lo]), False
                    chains.clear()
                for t in times[lo:hi].tolist():
                    newest = late = None
                    while chains and chains[0][0] + window <= t:
                        _, opener, last = chains.popleft()
                        if last is not None:
                            newest, late = opener, last
                        elif opener is not None:
                            newest = opener if newest is None else max(newest, opener)
                    # candidates: requests of the first window length and the one after
                    if not closed:
                        closed = t >= first + window
                        if closed:
                            late = t
                        else:
                            newest = t
                    if newest is not None or late is not None:
                        chains.append((t, newest, late))
            if len(out) > 10_000:
                yield emit()
        finish()
        yield emit()

    return run


def _carry(window: int):
    """Per chunk of a key, in order: the start of the window that is open when the chunk begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = chunk = start = None
        found = False
        for batch in batches:
            keys, chunks, openers, ends = _columns(batch, "key", "chunk", "opener", "last_start")
            out: list[tuple] = []
            for k, c, opener, end in zip(keys, chunks.tolist(), openers.tolist(), ends.tolist(), strict=True):
                if chunk is None or k != key:
                    key, chunk, start, found = k, c, None, False
                elif c != chunk:
                    chunk, found = c, False
                    out.append((k, c, start))
                if not found and (start is None or opener >= start + window):
                    # the first request from start + window on belongs to this class
                    start, found = end, True
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), type=t) for v, t in zip(cols, [pa.string(), pa.int64(), pa.int64()], strict=True)],
                names=["key", "chunk", "carry"],
            )

    return run


def _assign(window: int):
    """Add window start (microseconds) and place in the window to requests sorted by key, chunk, time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, start, count = None, None, 0
        for batch in batches:
            key, chunk, times = _columns(batch, "__key", CHUNK, "__t")
            carried = batch.column("__carry")
            starts, places = np.empty((2, len(times)), dtype="int64")
            for lo, hi in _runs(key, chunk):
                if group != (key[lo], chunk[lo]):
                    group, start, count = (key[lo], chunk[lo]), carried[lo].as_py(), 0
                at = lo
                while at < hi:
                    if start is None or times[at] >= start + window:
                        start, count = int(times[at]), 0
                    end = lo + int(np.searchsorted(times[lo:hi], start + window, side="left"))
                    starts[at:end] = start
                    places[at:end] = np.arange(count + 1, count + 1 + end - at)
                    count += end - at
                    at = end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(starts), pa.array(places)], names=[*batch.schema.names, "__start", "__place"]
            )

    return run


def _carried_windows(chunked: DataFrame, window: int) -> DataFrame:
    """(key, chunk, carry): the window open at the start of each chunk but the first of a hot key."""
    points = chunked.where(HOT).select(F.col("__key").alias("key"), F.col(CHUNK).alias("chunk"), F.col("__t").alias("t"))
    ends = (
        points.distinct()
        .repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk", "t")
        .mapInArrow(_chain_ends(window), "key string, chunk bigint, opener bigint, last_start bigint")
    )
    return (
        ends.repartition("key")
        .sortWithinPartitions("key", "chunk", "opener")
        .mapInArrow(_carry(window), "key string, chunk bigint, carry bigint")
    )


def rate_limit(
    events: DataFrame,
    key: str,
    ts: str,
    order: Sequence[str] = (),
    rpm: int = RPM,
    method: str | None = None,
    window_seconds: float = 60,
    *,
    min_rows: int = MIN_ROWS,
    parts: int = PARTS,
) -> DataFrame:
    """Add ``window_start``, ``window_count`` and ``over_limit`` to the counted requests.

    With ``method`` only POST, PUT, PATCH and DELETE count, and only they are
    returned.  ``order`` breaks ties between requests of the same time.
    """
    window = int(window_seconds * 1_000_000)
    if method:
        events = events.where(F.upper(F.col(method)).isin(*COUNTED_METHODS))
    columns = events.columns
    timed = events.withColumns(
        {"__key": F.col(key).cast("string"), "__t": F.unix_micros(F.col(ts).cast("timestamp"))}
    ).where(F.col("__t").isNotNull())
    chunked = with_chunk(timed, ["__key"], "__t", min_rows=min_rows, parts=parts)

    carry = None
    no_carry = F.lit(None).cast("bigint").alias("__carry")
    if chunked is None:
        ready = timed.select("*", F.lit(0).cast("bigint").alias(CHUNK), no_carry)
    else:
        # at most one row per chunk of a hot key, so at most 2 * parts rows
        carry = _carried_windows(chunked, window)
        here = F.col("__key").eqNullSafe(F.col("key")) & (F.col(CHUNK) == F.col("chunk"))
        ready = chunked.join(F.broadcast(carry), here, "left").select(
            *columns, "__key", "__t", CHUNK, F.col("carry").alias("__carry")
        )
    placed = (
        ready.repartition("__key", CHUNK)
        .sortWithinPartitions("__key", CHUNK, "__t", *order)
        .mapInArrow(_assign(window), ready.select("*", F.col("__t").alias("__start"), F.col("__t").alias("__place")).schema)
    )
    if carry is not None:
        # rows an open window already had in earlier chunks
        same = placed["__key"].eqNullSafe(F.col("key")) & (F.col("__start") == F.col("carry"))
        earlier = (
            placed.join(F.broadcast(carry), same & (F.col(CHUNK) < F.col("chunk")))
            .groupBy(F.col("key").alias("__ek"), F.col("chunk").alias("__ec"))
            .agg(F.count(F.lit(1)).alias("__earlier"))
        )
        here = F.col("__key").eqNullSafe(F.col("__ek")) & (F.col(CHUNK) == F.col("__ec"))
        joined = placed.join(F.broadcast(earlier), here & (F.col("__start") == F.col("__carry")), "left")
        placed = joined.withColumn("__place", F.col("__place") + F.coalesce("__earlier", F.lit(0)))
    return placed.select(
        *columns,
        F.timestamp_micros("__start").alias("window_start"),
        F.col("__place").alias("window_count"),
        (F.col("__place") > max(1, int(rpm))).alias("over_limit"),
    )
