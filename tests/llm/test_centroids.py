from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from flowtally.llm.centroids import cluster, lower_bounds, nearest, op11_centroids, quantized, roots, squared
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


def plain(vectors, k, rounds, seed=3):
    """Lloyd's rounds in Python integers; ``vectors`` are (id, list of integers)."""
    known = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None]
    centroids = [list(v) for _, v in sorted(known)[:k]]

    def assign():
        out = []
        for _, v in vectors:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)) if d else (None, None))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (x, _) in zip(vectors, found, strict=True) if x == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), centroids


def run(spark, vectors, k=8, rounds=4, size=3):
    made = cluster(spark.createDataFrame(vectors, "id long, v array<long>"), k, rounds, size)
    return rows(made.rows), made.centroids


def expected(vectors, k=8, rounds=4):
    found, centroids = plain(vectors, k, rounds)
    made = [(i, *f) for (i, _), f in zip(vectors, found, strict=True)]
    return sorted(made, key=lambda t: tuple((v is not None, str(v)) for v in t)), centroids


def test_query_equals_brute_force(spark):
    kept = []
    for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect():
        kept.append((r.vec_id, [math.floor(1024 * x) for x in r.embedding]))
    found, centroids = plain(kept, 8, 10)
    inertia = [sum(d for c, d in found if c == x) for x in range(8)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = {i: (c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (c, d) in zip(kept, found, strict=True)}
    got = {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in op11_centroids(spark, SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("spread", [1, 3, 50])
def test_ties_and_repeated_vectors(spark, spread):
    rnd = np.random.default_rng(spread)
    vectors = [(int(i), [int(x) for x in v]) for i, v in enumerate(rnd.integers(-spread, spread + 1, (120, 3)))]
    vectors += vectors[:10] + [(None, [0, 0, 0]), (None, [spread, 0, 0])]
    assert run(spark, vectors) == expected(vectors)


def test_few_rows_no_rows_and_rows_without_ids(spark):
    assert run(spark, [(1, [1, 2, 3])]) == expected([(1, [1, 2, 3])])
    assert run(spark, [(1, [5, 5, 5])] * 12) == expected([(1, [5, 5, 5])] * 12)
    assert run(spark, []) == ([], [])
    assert run(spark, [(None, [1, 2, 3])]) == ([(None, None, None)], [])


def test_huge_components_stay_exact(spark):
    big = 1 << 40
    vectors = [(i, [big * (i % 5), -big * (i % 3), i]) for i in range(40)]
    got, centroids = run(spark, vectors, 3, 2)
    want, plain_centroids = expected(vectors, 3, 2)
    assert centroids == plain_centroids
    assert got == sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in want), key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_rows_that_take_no_part(spark):
    good = [0.5, -0.0001]
    odd = [None, [], [1.0], [1.0, None], [1.0, float("nan")], [1.0, float("-inf")], [1.0, 2.0, 3.0]]
    data = [(i, v, 7, "x") for i, v in enumerate([good, *odd])] + [(None, good, 7, "y"), (0, good, 7, "z")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, v int, near string")
    assert rows(quantized(frame, 2)) == [(None, [512, -1]), (0, [512, -1]), (0, [512, -1])]
    assert rows(quantized(frame.where("1 = 0"), 2)) == []


def test_bounds_never_exceed_the_distance():
    rnd = np.random.default_rng(5)
    for scale in (1, 30, 1000, 10**6):
        v, pivots = rnd.integers(-scale, scale + 1, (400, 8)), rnd.integers(-scale, scale + 1, (5, 8))
        # centroids on a pivot, on a line through two pivots, and anywhere
        for c in (pivots[0], 2 * pivots[1] - pivots[0], rnd.integers(-scale, scale + 1, 8)):
            near = np.stack([roots(squared(v, p)) for p in pivots], axis=1)
            between = np.array([roots(squared(pivots, p)) for p in pivots])
            pairs = [(a, b) for a in range(5) for b in range(a)]
            bounds = lower_bounds(near, roots(squared(pivots, c)), between, pairs)
            exact = squared(v, c)
            # in integers: floor of the bound squared must not exceed the squared distance
            assert all(int(b) ** 2 <= int(d) for b, d in zip(bounds, exact, strict=True))
            assert (bounds <= roots(exact) + 1e-9 * scale).all()


def test_bounds_spare_most_checks_on_grouped_vectors():
    rnd = np.random.default_rng(6)
    centres = rnd.integers(-5000, 5000, (8, 64))
    v = (centres[np.arange(4000) % 8] + rnd.integers(-300, 300, (4000, 64))).astype(np.int64)
    near = np.stack([roots(squared(v, p)) for p in v[:8]], axis=1)
    found, distance, checked = nearest(v, near, centres, v[:8])
    every = np.stack([squared(v, c) for c in centres], axis=1)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert checked < 0.2 * every.size
