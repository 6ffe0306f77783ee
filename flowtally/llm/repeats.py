"""Repeated passages by longest previous factors, over a corpus of any size.

A text of L bytes that occurs twice has, in both places, the same smallest
k-gram hash (its anchor) at the same offset.  So the corpus is never sorted as
a whole: only stretches around anchors that occur twice meet, grouped by
anchor, and there suffixes are sorted down to L bytes.  In suffix order the
stretches that share L bytes or more are neighbours; the previous and the next
smaller position among them tell for each place whether an earlier or a later
copy exists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.lineage import cut, new_folder
from flowtally.llm.base import query, table

GRAM = 32
# bytes of a text hashed at once, so that a huge text needs no huge arrays
BLOCK = 1 << 20
# anchors a task sends at once
FLUSH = 1 << 16
# stretches sorted in one task, and the most stretches of one anchor that are sorted together
BUCKET, LARGE = 1024, 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of the ``GRAM`` bytes from each place, by doubling lengths."""
    h, size = raw.astype(np.uint64) + np.uint64(1), 1
    factor = _BASE
    while size < GRAM:
        h = h[:-size] * factor + h[size:]
        factor, size = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF), size * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: minima from both ends of blocks of that width."""
    n = len(values) - width + 1
    pad = -len(values) % width
    rows = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, hash, first window)`` of each anchor.

    The anchor of a window of ``length`` bytes is its leftmost gram of smallest
    hash; windows from ``first window`` up to the next anchor's have this one.
    Empty for texts shorter than a window.
    """
    windows = len(text) - length + 1
    grams = length - GRAM + 1
    places, hashes, firsts = [], [], []
    for at in range(0, max(windows, 0), BLOCK):
        stop = min(at + BLOCK, windows)
        h = gram_hashes(np.frombuffer(text, np.uint8, stop - at + length - 1, at))
        # the leading 43 bits decide, then the place within the block
        tagged = (h >> np.uint64(21) << np.uint64(21)) | np.arange(len(h), dtype=np.uint64)
        chosen = (_least_in_windows(tagged, grams) & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        places.append(chosen[new] + at)
        hashes.append(h[chosen[new]].view(np.int64))
        firsts.append(new + at)
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none
    place, first = np.concatenate(places), np.concatenate(firsts)
    # an anchor that goes on over a block border is one
    keep = np.concatenate(([True], place[1:] != place[:-1]))
    return place[keep], np.concatenate(hashes)[keep], first[keep]


def stretches(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, start, end)`` of each anchor: the stretch of its windows."""
    place, hashes, first = anchors(text, length)
    last = np.append(first[1:], len(text) - length + 1)[: len(place)] - 1
    return hashes, first, last + length


def factor_flags(parts: list[bytes], owner: np.ndarray, start: np.ndarray, copies: np.ndarray, length: int):
    """``(earlier, any)`` for each window of each part: is there an earlier copy, is there any?

    ``owner`` and ``start`` say which text a part is from and where it begins
    there; ``copies`` above 1 marks parts that occur several times as a whole.
    Suffixes are ranked by doubled prefixes, 8 bytes first, down to ``length``
    bytes.  Equal ranks are runs of the suffix order that share ``length`` bytes;
    within a run positions are ordered, so a place has a previous smaller
    position unless it is the first, and a next one unless it is the last.
    Parts that overlap in their text show one place twice; that is one position.
    """
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts) + bytes(length + 8), np.uint8)
    n = int(size.sum())
    part = np.repeat(np.arange(len(parts)), size)
    offset = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | raw[i : n + i]
    rank, depth = np.unique(word, return_inverse=True)[1].astype(np.int64), 8

    def joined(first: np.ndarray, gap: int) -> np.ndarray:
        # beyond the end of all parts any rank does: such windows are not asked for
        second = np.concatenate((rank[gap:], np.zeros(gap, np.int64)))
        return first * (n + 1) + second

    while depth * 2 <= length:
        rank, depth = np.unique(joined(rank, depth), return_inverse=True)[1].astype(np.int64), depth * 2
    final = joined(rank, length - depth)
    whole = np.nonzero(size[part] - offset >= length)[0]
    key, who, at = final[whole], owner[part[whole]], (start[part] + offset)[whole]
    order = np.lexsort((at, who, key))
    key, who, at, many = key[order], who[order], at[order], copies[part[whole]][order] > 1
    new_run = np.concatenate(([True], key[1:] != key[:-1]))
    run = np.cumsum(new_run) - 1
    head = np.nonzero(new_run)[0]
    tail = np.append(head[1:], len(key)) - 1
    same_head = (who == who[head][run]) & (at == at[head][run])
    same_tail = (who == who[tail][run]) & (at == at[tail][run])
    several = np.bincount(run, many, len(head))[run] > 0
    flags = np.zeros((2, n), bool)
    flags[0, whole[order]] = ~same_head
    flags[1, whole[order]] = ~same_head | ~same_tail | several
    bounds = np.cumsum(size)[:-1]
    return np.split(flags[0], bounds), np.split(flags[1], bounds)


def spans_of(flags: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Byte spans that the flagged windows cover."""
    at = np.nonzero(flags)[0]
    if not len(at):
        return []
    gap = np.nonzero(np.diff(at) > length)[0]
    begin, stop = at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))]
    return [(int(b) + start, int(e) + start + length) for b, e in zip(begin, stop, strict=True)]


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def _packed(docs: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """``id_cols`` with the text's digest ``t`` and its compressed bytes ``z``, so that less is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = b.column("_text").to_pylist()
            rest = [b.column(c) for c in id_cols]
            new = [pa.array(map(_digest, texts), pa.binary()), pa.array(map(squeeze, texts), pa.binary())]
            yield pa.RecordBatch.from_arrays(rest + new, [*id_cols, "t", "z"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    d = docs.select(*id_cols, text.alias("_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]], "t binary, z binary"])
    return d.mapInArrow(pack, schema)


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 200, keep_first: bool = True) -> DataFrame:
    """``(t, spans)``: byte spans to remove per distinct text, ``t`` being the text's 128-bit digest.

    A span is covered by strings of ``length`` bytes that start elsewhere too:
    earlier, if ``keep_first`` (texts are ordered by digest), else anywhere.
    Strings are judged on the input and never cross rows.  Every occurrence is
    looked at: anchors that occur once are dropped, stretches that are equal as
    a whole are counted before they move on, and of the rest each anchor's
    stretches are sorted together.  Anchors with more than ``LARGE`` different
    stretches are settled by counting their windows' 128-bit digests, which has
    no group at all.  NULL and short texts have no spans.
    """
    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ready = [], []

        def flushed():
            numbers = np.repeat(np.arange(len(names)), [len(r[0]) for r in ready])
            columns = [pa.array(np.concatenate(c)) for c in zip(*ready, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).take(pa.array(numbers)), *columns], ["t", "anchor", "begin", "end"])

        for b in batches:
            size = 0
            for text in b.column("text"):
                text = text.as_py()
                rows = stretches(text, length)
                if len(rows[0]):
                    names.append(_digest(text))
                    ready.append(rows)
                    size += len(rows[0])
                if size > FLUSH:
                    yield flushed()
                    names, ready, size = [], [], 0
            if names:
                yield flushed()
                names, ready = [], []

    # written once, read by the counts and by the join
    folder = new_folder(spark, "anchors")
    found = _texts(docs, text_col).mapInArrow(find, "t binary, anchor long, begin long, end long")
    found.write.option("compression", "zstd").parquet(folder)
    found = spark.read.parquet(folder)
    # on its own, so that both sides of the join are shuffled for it and AQE can split a frequent anchor
    twice = cut(found.groupBy("anchor").count().where("count > 1").select("anchor"))
    known = found.join(twice, "anchor").groupBy("t").agg(F.collect_set(F.struct("begin", "end", "anchor")).alias("known"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows, size = [], 0
            for t, z, n, known in zip(*(b.column(c) for c in ("t", "z", "n", "known")), strict=True):
                t, n, text = t.as_py(), n.as_py(), unpack(z.as_py())
                columns = (known.values.field(c).to_pylist() for c in ("begin", "end", "anchor"))
                for begin, end, anchor in sorted(zip(*columns, strict=True)):
                    rows.append((t, n, anchor, begin, text[begin:end]))
                    size += end - begin
                    if size > BLOCK:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["t", "n", "anchor", "begin", "part"])

    # equal texts go on as one with their number, combined before the shuffle that the join needs anyway
    texts = _packed(docs, [], text_col).groupBy("t").agg(F.first("z").alias("z"), F.count("*").alias("n"))
    near = texts.join(known, "t").mapInArrow(around, "t binary, n long, anchor long, begin long, part binary")
    # written once, read by the counts and by the places
    folder = new_folder(spark, "stretches")
    near.withColumn("h", F.unhex(F.md5("part"))).write.option("compression", "zstd").parquet(folder)
    near = spark.read.parquet(folder)
    here = F.struct("t", "begin")
    counts = near.groupBy("anchor", "h").agg(F.sum("n").alias("copies"), F.min(here).alias("first"))
    counts = cut(counts)
    # a stretch that is the only one of its anchor needs no sorting
    sizes = counts.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1")
    sorted_ = counts.join(sizes, "anchor")
    first = sorted_.select("anchor", "copies", "different", "first.t", "first.begin")
    whole = near.select("t", "begin", "part", "anchor").join(first, ["anchor", "t", "begin"])
    number = sizes.agg(F.sum("different")).first()[0] or 0
    buckets = max(1, math.ceil(number / BUCKET))
    small = whole.where(F.col("different") <= LARGE).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        owners, owner = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        begin = pdf["begin"].to_numpy()
        flags = factor_flags(pdf["part"].tolist(), owner, begin, pdf["copies"].to_numpy(), length)
        which = flags[0] if keep_first else flags[1]
        rows = [(t, s, e) for t, b, f in zip(pdf["t"], begin, which, strict=True) for s, e in spans_of(f, int(b), length)]
        return pd.DataFrame(rows, columns=["t", "begin", "end"])

    spans = small.groupBy("bucket").applyInPandas(sort, "t binary, begin long, end long")

    large = whole.where(F.col("different") > LARGE)
    if sizes.where(F.col("different") > LARGE).limit(1).count():
        spans = spans.union(_large_spans(large, length, keep_first))
    # stretches that occur several times as a whole: all of them, or all but the first, which the sort has seen
    again = counts.where("copies > 1").select("anchor", "h", "first")
    same = near.select("t", "begin", F.length("part").alias("size"), "anchor", "h").join(again, ["anchor", "h"])
    if keep_first:
        same = same.where(F.struct("t", "begin") != F.col("first"))
    spans = spans.union(same.select("t", "begin", (F.col("begin") + F.col("size")).alias("end")))
    return spans.groupBy("t").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def _large_spans(large: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The spans of anchors with very many stretches: window digests are counted, then joined back."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, begin, part, copies in zip(*(b.column(c).to_pylist() for c in ("t", "begin", "part", "copies")), strict=True):
                h = [xxhash.xxh3_128_digest(part[i : i + length]) for i in range(len(part) - length + 1)]
                at = np.arange(begin, begin + len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.binary()), pa.array([t] * len(h), pa.binary()), pa.array(at), pa.array([copies] * len(h), pa.int64())],
                    ["w", "t", "at", "copies"],
                )

    rows = large.select("t", "begin", "part", "copies").mapInArrow(windows, "w binary, t binary, at long, copies long")
    here = F.struct("t", "at")
    runs = rows.groupBy("w").agg(F.min(here).alias("low"), F.max(here).alias("high"), F.max("copies").alias("most"))
    runs = runs.where((F.col("low") != F.col("high")) | (F.col("most") > 1))
    hit = rows.join(runs, "w")
    hit = hit.where(here != F.col("low")) if keep_first else hit
    return hit.select("t", F.col("at").alias("begin"), (F.col("at") + length).alias("end"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, id_cols: list[str], text_col: str = "text", length: int = 200, keep_first: bool = True) -> DataFrame:
    """``id_cols`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``removed`` (merged spans).

    A row per input row; rows with equal texts share the decision on them.
    With ``keep_first`` the copies inside equal texts are told apart by text,
    not by row.  Adjoining spans are one.
    """
    spans = repeated_spans(docs, text_col, length, keep_first)
    inner = [f"_id{i}" for i in range(len(id_cols))]
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(id_cols, inner, strict=True)], F.col(text_col).alias("_whole"))
    joined = _packed(source, inner, "_whole").join(spans, "t", "left")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            at = 0
            while at < b.num_rows:
                kept, sizes, gone, runs, begin = [], [], [], [], at
                # texts of some megabytes at once, whatever they were packed to
                while at < b.num_rows and sum(sizes) < 8 * BLOCK:
                    text, merged, done, pieces = unpack(b.column("z")[at].as_py()), _merged(b.column("spans")[at].as_py()), 0, []
                    for first, end in merged:
                        pieces.append(text[done:first])
                        done = end
                    pieces.append(text[done:])
                    kept.append(b"".join(pieces))
                    sizes.append(len(text))
                    gone.append(len(text) - len(kept[-1]))
                    runs.append([{"begin": s, "end": e} for s, e in merged])
                    at += 1
                new = [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, kind)]
                ids = [b.column(c).slice(begin, at - begin) for c in inner]
                yield pa.RecordBatch.from_arrays(ids + new, [*inner, "kept", "n_bytes", "n_removed", "removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = f"{fields}, kept binary, n_bytes long, n_removed long, removed array<struct<begin:long,end:long>>"
    out = joined.select(*inner, "z", "spans").mapInArrow(drop, schema)
    return out.toDF(*id_cols, "kept", "n_bytes", "n_removed", "removed")


@query("op7_repeats")
def op7_repeats(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], keep_first=False)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
