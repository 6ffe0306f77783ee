from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np

from flowtally.llm import ann
from flowtally.llm.ann import Index, fit, nearest, op2_nearest, probe_sets

SMALL = "/root/testdata/sf0.001"


def plain(vectors, query, k=20):
    ids = np.array([i for i in sorted(vectors) if i != query])
    # cumsum adds up in order; sum() would compensate
    score = (np.array([vectors[i] for i in ids], float) * np.array(vectors[query], float)).cumsum(axis=1)[:, -1]
    order = np.lexsort((ids, -score))[:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def by_query(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_query_recall_and_exact_scores(spark):
    got = by_query(op2_nearest(spark, SMALL).collect())
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    assert sorted(got) == [i for i in sorted(vectors) if i % 20 == 0]
    hits = 0
    for q, found in got.items():
        exact = dict(plain(vectors, q, len(vectors)))
        assert len(found) == 20 and all(exact[i] == s for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({i for i, _ in found} & {i for i, _ in plain(vectors, q)})
    assert hits >= 0.9 * 20 * len(got)


def test_probe_order_is_by_score_and_valid():
    sets = probe_sets(5, 200)
    assert not sets[0].any() and len({tuple(s) for s in sets}) == len(sets)
    assert all(not (s[r] and s[9 - r]) for s in sets for r in range(10))
    k = 5
    z = [(i + 1) * (i + 2) / (4 * (k + 1) * (k + 2)) for i in range(k)]
    z += [1 - (10 - i) / (k + 1) + (10 - i) * (11 - i) / (4 * (k + 1) * (k + 2)) for i in range(k, 10)]
    scores = [sum(z[r] for r in range(10) if s[r]) for s in sets]
    assert np.allclose(scores, sorted(scores))
    # nothing cheaper is left out
    every = [c for n in range(1, 6) for c in combinations(range(10), n) if not any(9 - r in c for r in c)]
    assert np.allclose(scores[1:], sorted(sum(z[r] for r in c) for c in every)[: len(sets) - 1])


def test_own_bucket_is_the_first_probe():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = Index.make(8, 2, 6, 2.0, {0: 1.0})
    lifted = np.concatenate([x, np.zeros((50, 1))], axis=1)
    for t in range(2):
        assert (index.probe_codes(x, t, 9)[:, 0] == index.codes(lifted, t)).all()


def test_norm_bands_keep_short_vectors_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * (1000.0 if i % 50 == 0 else 1.0)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(nearest(df, df.where("vec_id % 20 = 0")).collect())
    vectors = dict(rows)
    hits = sum(len({i for i, _ in f} & {i for i, _ in plain(vectors, q)}) for q, f in got.items())
    assert hits >= 0.9 * 20 * 30


def test_edges(spark):
    base = np.eye(8)
    rows = [(i, base[i].tolist()) for i in range(8)]
    rows += [(20, base[0].tolist()), (21, base[0].tolist()), (22, base[0].tolist()), (0, base[0].tolist())]
    rows += [(40, None), (60, []), (80, [0.0] * 8), (100, [float("nan")] * 8), (120, [None] + [1.0] * 7), (140, [float("inf")] * 8), (None, [1.0] * 8), (160, [1.0])]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = by_query(nearest(df, df.where("vec_id % 20 = 0"), recall=1.0).collect())
    assert sorted(got) == [0, 20]
    assert [i for i, _ in got[0]][:3] == [20, 21, 22] and [i for i, _ in got[20]][:3] == [0, 21, 22]
    assert len(got[0]) == 10 and got[0][0][1] == 1.0
    assert nearest(df.where("1 = 0"), df).collect() == [] and nearest(df, df.where("1 = 0")).collect() == []


def test_many_equal_vectors_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=12).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=12).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = by_query(nearest(df, df.where("vec_id % 20 = 0")).collect())
    same = [i for i in range(400) if i % 3]
    for q in (20, 40):
        assert [i for i, _ in got[q]] == [i for i in same if i != q][:20]
        assert len({s for _, s in got[q]}) == 1


def test_fit_on_few_rows():
    x = np.eye(3)
    for n in (1, 2, 3):
        assert fit(x[:n], n, 20, {0: 1.0}).probes >= 1


def test_twenty_one_rows_give_twenty_each(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(21)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert got == {q: plain(dict(rows), q) for q in (0, 20)}


def test_queries_probe_on_until_they_have_enough():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 16))
    norm = np.linalg.norm(x, axis=1)
    bands = {e: norm.max() for e in range(-2, 6)}
    index = Index.make(16, 4, 8, 1.0, bands)
    lifted = index.rows(x)
    few = ann.candidates(index, lifted, x[:40])
    more = ann.candidates(index, lifted, x[:40], 25)
    assert few.sum(axis=1).min() < 25 <= more.sum(axis=1).min() and not (few & ~more).any()
    assert ann.candidates(index, lifted, x[:2], 1000).all()


def _recall(got, x):
    score = x[sorted(got)] @ x.T
    hits = 0
    for row, q in zip(score, sorted(got), strict=True):
        row[q] = -np.inf
        hits += sum(s >= np.sort(row)[-20] - 1e-9 for _, s in got[q])
    return hits / (20 * len(got))


def test_every_block_meets_every_shard_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 256)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 32)
    x = np.random.default_rng(13).normal(size=(1500, 16))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = by_query(nearest(df, df.where("vec_id % 20 = 0")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 75 and _recall(got, x) >= 0.95


def test_queries_unlike_the_rows_find_their_nearest(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(60, 48))
    x = centres[rng.integers(60, size=2400)] + 0.05 * rng.normal(size=(2400, 48))
    x[::20] = rng.normal(size=(120, 48))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").coalesce(1)
    got = by_query(nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert len(got) == 120 and _recall(got, x) >= 0.9


def test_buckets_of_a_shard_are_made_once_for_all_queries(monkeypatch):
    x = np.random.default_rng(15).normal(size=(500, 8))
    index = Index.make(8, 3, 4, 1.0, {e: 10.0 for e in range(-8, 8)})
    lifted = index.rows(x)
    tables = ann.filled(index, lifted)
    want = ann.candidates(index, lifted, x[:30], 25)
    monkeypatch.setattr(Index, "codes", None)
    assert (ann.candidates(index, lifted, x[:30], 25, tables) == want).all()


def test_matrix_product_rules_out_no_tie_in_one_large_shard(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(6000, 24))
    x[1::7] = x[1]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(20, x[1].tolist()), (40, (-x[1]).tolist())], "vec_id long, embedding array<double>")
    got = by_query(nearest(df, asked, recall=1.0).collect())
    assert len(x) <= ann.SHARD_ROWS
    vectors = dict(enumerate(x.tolist()))
    for q, vector in ((20, x[1]), (40, -x[1])):
        assert got[q] == plain({**vectors, q: vector.tolist()}, q)
