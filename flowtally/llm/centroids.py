"""Centroid clustering in exact integers, candidates pruned by Ptolemaic lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.lineage import cut, new_folder
from flowtally.llm.base import query, table

LONG = (1 << 63) - 1
# many times the rounding error of the few double operations behind a bound
SLACK = 2.0**-46


def quantized(vectors: DataFrame, size: int, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, v)``: vectors of exactly ``size`` components, none NULL or non-finite, as integers floor(scale * x).

    Other rows are left out.  Repeated rows and rows with a NULL id stay.  No
    other column is read.  Scaled components must fit a long.
    """
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    d = d.where((F.size("v") == size) & F.coalesce(finite, F.lit(False)))
    return d.select("id", F.transform("v", lambda e: F.floor(F.lit(float(scale)) * e)).alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` to ``c``; Python integers where longs could overflow."""
    small = isqrt(LONG // (4 * max(1, len(c))))
    if all(-small <= a.min(initial=0) and a.max(initial=0) <= small for a in (v, c)):
        d = v - c
        return np.einsum("ij,ij->i", d, d)
    d = v.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def lower_bounds(near: np.ndarray, to_pivots: np.ndarray, between: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Lower bounds of the distances between vectors and one centroid, never above the true ones.

    ``near[i, p]`` are the cached distances of vector i to pivot p,
    ``to_pivots[p]`` those of the centroid.  Ptolemy's inequality gives for any
    pivots p and s: d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|.
    Every operation rounds, so the bound is lowered by more than all the errors
    can add up to.  Pairs of equal pivots say nothing.
    """
    best = np.zeros(len(near))
    for p, s in pairs:
        if between[p, s] > 0:
            one, other = near[:, p] * to_pivots[s], near[:, s] * to_pivots[p]
            bound = (np.abs(one - other) - SLACK * (one + other)) / between[p, s]
            np.maximum(best, bound, out=best)
    return best * (1 - SLACK)


def nearest(v: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each vector's nearest centroid (ties: the smaller), exact squared distance, and exact checks made.

    The centroid with the smallest bound is checked first; another one only
    while its bound does not exceed the best exact distance so far.  Centroid
    c looks at the pairs with pivot c, the place it started from.
    """
    k, m = len(centroids), len(pivots)
    to_pivots = np.array([roots(squared(pivots, c)) for c in centroids])
    between = np.array([roots(squared(pivots, p)) for p in pivots])
    pairs = list(combinations(range(m), 2))
    bounds = np.empty((len(v), k))
    for c in range(k):
        bounds[:, c] = lower_bounds(near, to_pivots[c], between, [x for x in pairs if c % m in x])
    bounds *= bounds
    bounds *= 1 - SLACK
    cluster = np.argmin(bounds, axis=1)
    distance = np.zeros(len(v), np.int64)
    checked = len(v)
    for c in range(k):
        rows = np.flatnonzero(cluster == c)
        found = squared(v[rows], centroids[c])
        distance = distance.astype(object) if found.dtype == object else distance
        distance[rows] = found
    first = cluster.copy()
    for c in range(k):
        rows = np.flatnonzero((first != c) & (bounds[:, c] <= distance.astype(np.float64) * (1 + SLACK)))
        found = squared(v[rows], centroids[c])
        checked += len(rows)
        closer = (found < distance[rows]) | ((found == distance[rows]) & (c < cluster[rows]))
        if found.dtype == object:
            distance = distance.astype(object)
        cluster[rows[closer]] = c
        distance[rows[closer]] = found[closer]
    return cluster, distance, checked


def _matrix(column: pa.Array, size: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, size)


@dataclass
class Clustering:
    """``rows(id, cluster, distance)``, the final centroids, and per round the exact checks per vector and centroid."""

    rows: DataFrame
    centroids: list[list[int]]
    checked: list[float] = field(default_factory=list)


def cluster(points: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> Clustering:
    """Lloyd's rounds over ``points(id, v)`` from ``quantized``, all in integers.

    The start is the ``k`` rows with the smallest sha256 of ``seed:id``, in
    that order (ties of repeated ids: the smaller vector); fewer rows with an
    id give fewer centroids.  Each round assigns every vector to its nearest
    centroid and replaces every non-empty one by the floor of its vectors'
    mean; empty ones stay.  Rows with a NULL id take part but start nothing;
    with no other rows their cluster is NULL.  A distance beyond a long is NULL.

    The start doubles as the pivots.  Vectors and their distances to them are
    written once to the shared folder and read each round; a task returns one
    row of sums per centroid, so k rows reach the driver, at any size.
    """
    spark = points.sparkSession
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = points.where("id IS NOT NULL").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return Clustering(points.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), [])
    centroids = [list(r["v"]) for r in first]
    pivots = np.array(centroids, np.int64)

    def cached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), size, np.int64)
            near = np.stack([roots(squared(v, p)) for p in pivots], axis=1)
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.ListArray.from_arrays(ends, near.ravel())], ["id", "v", "near"])

    folder = new_folder(spark, "centroids")
    points.mapInArrow(cached, "id long, v array<long>, near array<double>").write.parquet(folder)
    stored = spark.read.schema("id long, v array<long>, near array<double>").parquet(folder)

    def matrices(b: pa.RecordBatch):
        return _matrix(b.column("v"), size, np.int64), _matrix(b.column("near"), len(pivots), np.float64)

    kind = f"cluster int, n long, checked long, sums array<decimal({38},0)>"

    def partial(now: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, checked, totals = [0] * len(now), 0, np.zeros(now.shape, object)
            for b in batches:
                v, near = matrices(b)
                found, _, some = nearest(v, near, now, pivots)
                checked += some
                for c in range(len(now)):
                    mine = v[found == c]
                    n[c] += len(mine)
                    if len(mine) and max(-int(mine.min()), int(mine.max())) > LONG // len(mine):
                        mine = mine.astype(object)
                    totals[c] += mine.sum(axis=0).astype(object)
            full = [c for c in range(len(now)) if n[c]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([n[c] for c in full], pa.int64()),
                    pa.array([checked if c == full[0] else 0 for c in full], pa.int64()),
                    pa.array([[Decimal(int(x)) for x in totals[c]] for c in full], pa.list_(pa.decimal128(38, 0))),
                ],
                ["cluster", "n", "checked", "sums"],
            )

        return sums

    shares = []
    for _ in range(rounds):
        parts = stored.select("v", "near").mapInArrow(partial(np.array(centroids, np.int64)), kind)
        sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]
        found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("checked").alias("checked"), *sums).collect()
        for r in found:
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
        shares.append(sum(r["checked"] for r in found) / (sum(r["n"] for r in found) * len(centroids)))
    last = np.array(centroids, np.int64)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, distance, _ = nearest(*matrices(b), last, pivots)
            kept = pa.array([int(d) if d <= LONG else None for d in distance], pa.int64()) if distance.dtype == object else pa.array(distance)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found.astype(np.int32)), kept], ["id", "cluster", "distance"])

    return Clustering(stored.mapInArrow(assigned, "id long, cluster int, distance long"), centroids, shares)


def _sql(k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> str:
    """The same rounds as one chain of tables, a component a row."""
    steps = [
        f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(range({size})) AS i, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM p),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM p
          WHERE vec_id IS NOT NULL QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN v USING (r))"""
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""
d{t} AS (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{t} c USING (i) GROUP BY v.r, c.c),
a{t} AS MATERIALIZED (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if t < rounds:
            steps.append(
                f"""
m{t} AS (SELECT a.c, v.i, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
         FROM v JOIN a{t} a USING (r) GROUP BY a.c, v.i),
c{t + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{t} o LEFT JOIN m{t} m ON m.c = o.c AND m.i = o.i)"""
            )
    return (
        ",".join(steps)
        + f""",
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS "cluster", d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, s AS centroid_sha256
FROM a{rounds} JOIN p USING (r) JOIN h USING (c)"""
    )


@query("op11_centroids", _sql())
def op11_centroids(spark, sf_dir):
    made = cluster(quantized(table(spark, sf_dir, "embeddings"), 64))
    rows = cut(made.rows)
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centroids]
    # one row per centroid
    facts = spark.createDataFrame(
        [(c, inertia.get(c), d) for c, d in enumerate(digest)], "c int, cluster_inertia decimal(38,0), centroid_sha256 string"
    )
    total = F.lit(sum((s or 0 for s in inertia.values()), Decimal(0)))
    joined = rows.join(F.broadcast(facts), F.col("cluster") == F.col("c"), "left")
    return joined.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        F.col("cluster_inertia").try_cast("long").alias("cluster_inertia"),
        total.try_cast("long").alias("inertia"),
        "centroid_sha256",
    )
