"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.lineage import cut
from flowtally.llm.base import query, table
from flowtally.llm.components import components

SEED = 42
# shingles whose bits are counted at once, so that a huge text needs no huge arrays
BLOCK = 1 << 16
# rows of byte b: the eight bits of b, lowest first
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, signed as Spark stores longs.

    A-Z is lower-cased, words are split at ASCII white space, and every run of
    ``shingle`` words counts, repeats included; a shorter text is one shingle,
    a text without words is 0.  A bit is set if it is set in over half of the
    shingles' XXH64 values.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        span = zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in span], np.uint64)
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts[8 * byte : 8 * byte + 8] += np.bincount(columns[:, byte], minlength=256) @ _BITS
    bits = counts * 2 > len(first)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of which at least one ignores any chosen ``radius`` bits.

    Bit i gets a vector of radius + 1 bits; mask v keeps the bits whose vector
    has odd inner product with v.  Any ``radius`` vectors leave some non-zero v
    orthogonal to all of them, so the mask of that v keeps none of those bits:
    2^(radius + 1) - 1 tables and no pair within the radius is missed.
    """
    size = 1 << (radius + 1)
    # a fixed mixing of the bit number spreads vectors evenly over the bits
    vector = [(i * 0x9E3779B97F4A7C15 >> 32) % (size - 1) + 1 for i in range(bits)]
    masks = []
    for v in range(1, size):
        kept = sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def _ball_links(members: DataFrame) -> DataFrame:
    """Links among fingerprints through the points one bit away from them.

    Two fingerprints differ in at most two bits exactly if their balls of
    radius one meet.  A point is met by 65 fingerprints at most, so the work is
    65 rows per fingerprint whatever the bucket holds.  Every member of a ball
    is linked to the ball's first member; the reached sets stay the same.
    """
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    points = members.select("fp", "id", F.explode(flips).alias("point"))
    met = points.groupBy("point").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    first = met.select(F.array_min("ids").alias("b"), F.explode("ids").alias("a"))
    return first.where("a <> b").select("a", "b")


def near_links(prints: DataFrame, radius: int = 2, bucket: int = 32) -> DataFrame:
    """Links ``(a, b)`` that join the distinct fingerprints ``(fp, id)`` within ``radius`` bits.

    Candidates share a bucket of some covering table.  Buckets of up to
    ``bucket`` members are compared pair by pair.  The members of larger ones
    are linked exactly through balls, which is linear; that way needs radius 2.
    Radii 0 and 1 meet such members through their own points; a larger radius
    raises ``ValueError``.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
    rows = prints.select("fp", "id", F.explode(tables).alias("b")).select("fp", "id", "b.t", "b.k")
    counts = rows.groupBy("t", "k").count().where("count > 1")
    kept = cut(rows.join(counts, ["t", "k"]))
    small = kept.where(F.col("count") <= bucket).drop("count")
    other = small.select("t", "k", F.col("fp").alias("fp2"), F.col("id").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    pairs = small.join(other, ["t", "k"]).where((F.col("b") < F.col("id")) & near).select(F.col("id").alias("a"), "b")
    large = kept.where(F.col("count") > bucket).select("fp", "id").distinct()
    if radius == 2:
        return pairs.union(_ball_links(large)).distinct()
    if radius < 2:
        flips = [F.lit(0)] + [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)][: 64 * radius]
        moved = large.select("id", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("fp"))
        met = moved.join(large.select("fp", F.col("id").alias("b")), "fp").where("b < id")
        return pairs.union(met.select(F.col("id").alias("a"), "b")).distinct()
    raise ValueError("radius above 2 has no bounded way for large buckets")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fingerprint long, component_id, group_id)``: one row per input row; ``group_id`` is a fingerprint of its group.

    Fingerprints are made in Arrow batches next to the scan; only
    ``(id, fingerprint)`` travels.  Equal fingerprints are one class, so a
    group of copies of any size is one node of the link table, and its members
    get their component by a join on the fingerprint, which AQE splits.

    NULL and blank texts have fingerprint 0 and are linked like any other.
    Rows with a NULL id get a fingerprint, and the component of the other rows
    of their class; NULL if no row they reach has an id.  Repeated rows stay.
    Other columns are not read.
    """

    def prints(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": [fingerprint(t, shingle) for t in b["text"]]})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the long id column may hold NULL, which pandas would turn into floats
    source = source.select(F.col("id").cast("string").alias("id"), "text")
    made = source.mapInPandas(prints, "id string, fp long").select(F.col("id").cast("long").alias("id"), "fp")
    made = cut(made)
    classes = cut(made.groupBy("fp").agg(F.min("id").alias("low")))
    nodes = classes.select("fp", F.col("fp").alias("id"))
    linked = components(near_links(nodes, radius))
    # the component of a class is the smallest id of all classes it reaches
    whole = classes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left")
    whole = whole.select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = whole.join(lowest, "component").select("fp", "component_id", F.col("component").alias("group_id"))
    return made.join(classes, "fp").select("id", F.col("fp").alias("fingerprint"), "component_id", "group_id")


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with one more column, the fingerprint of its text."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle))

    return docs.withColumn(name, prints(F.col(text_col).cast("string")))


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
