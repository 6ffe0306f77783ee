"""Nearest neighbours by inner product: multi-probe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowtally.lineage import cut
from flowtally.llm.base import hash_bound, query, table

# rows of the fitting sample, and how many of them serve as its queries
SAMPLE, SAMPLE_QUERIES = 4096, 256
# rows and queries that meet in one task: a shard of the index and a block of queries.  Probing costs a query the same
# in a shard of any size, so shards are as large as a task can hold
SHARD_ROWS, QUERY_BLOCK = 32768, 1024
# queries of a block that are looked up at once
AT_ONCE = 256
# numbers of hash functions a table may have, and the most buckets a query may visit in it
HASHES, MOST_PROBES = (12, 10, 8, 6, 4), 2048
# the normal distribution function at steps of 0.005
_AT = np.linspace(-8, 8, 3201)
_CDF = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _AT.tolist()])


@lru_cache(maxsize=16)
def probe_sets(k: int, count: int) -> np.ndarray:
    """The first ``count`` perturbation sets as rows of 2k flags, in the order of expected success.

    A query's 2k distances to the borders of its cells are ranked; a set names
    ranks, and its expected score is the sum of the expected squares of those
    distances.  Sets grow by shifting or extending their last rank, which a
    heap visits by score.  Ranks i and 2k - 1 - i are the two borders of one
    cell, so a set never has both.  The empty set, the query's own bucket, is first.
    """
    m = 2 * k
    near = [(i + 1) * (i + 2) / (4 * (k + 1) * (k + 2)) for i in range(k)]
    far = [1 - (m - i) / (k + 1) + (m - i) * (m - i + 1) / (4 * (k + 1) * (k + 2)) for i in range(k, m)]
    score = near + far
    out = [np.zeros(m, np.int64)]
    heap = [(score[0], (0,))]
    while heap and len(out) < count:
        total, ranks = heapq.heappop(heap)
        if not any(m - 1 - r in ranks for r in ranks):
            row = np.zeros(m, np.int64)
            row[list(ranks)] = 1
            out.append(row)
        last = ranks[-1]
        if last + 1 < m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*ranks, last + 1)))
    return np.asarray(out)


@dataclass(frozen=True)
class Index:
    """Hash functions of all tables and the scale of each norm band; its size does not depend on the data."""

    directions: np.ndarray  # tables x hashes x (dimension + 1)
    offsets: np.ndarray  # tables x hashes
    mixers: np.ndarray  # tables x hashes, random 64-bit numbers
    width: float
    probes: int
    bands: dict[int, float]

    @staticmethod
    def make(dimension: int, tables: int, hashes: int, width: float, bands: dict[int, float], seed: int = 5) -> Index:
        rng = np.random.default_rng(seed + hashes)
        directions = rng.standard_normal((tables, hashes, dimension + 1))
        mixers = rng.integers(-(1 << 63), (1 << 63) - 1, (tables, hashes), dtype=np.int64)
        return Index(directions, rng.random((tables, hashes)) * width, mixers, width, 1, bands)

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors scaled by the largest norm of their band, lifted to the unit sphere by one more component.

        For a unit query the distance to a lifted vector falls as the inner
        product grows, so hashing for distance serves inner products.  Bands
        are powers of two of the norm; without them one long vector would
        press all others together.
        """
        norm = np.linalg.norm(vectors, axis=1)
        largest = np.array([self.bands[int(e)] for e in np.rint(np.log2(norm))])
        scaled = vectors / largest[:, None]
        rest = np.sqrt(np.clip(1 - (scaled * scaled).sum(axis=1), 0, None))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def codes(self, lifted: np.ndarray, t: int) -> np.ndarray:
        cells = np.floor((lifted @ self.directions[t].T + self.offsets[t]) / self.width).astype(np.int64)
        return (cells * self.mixers[t]).sum(axis=1)

    def probe_codes(self, queries: np.ndarray, t: int, count: int) -> np.ndarray:
        """Bucket codes of table ``t`` that each query visits, in order: queries x probes."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        place = (unit @ self.directions[t][:, :-1].T + self.offsets[t]) / self.width
        cells = np.floor(place)
        inside = place - cells
        k = cells.shape[1]
        # squared distance to the lower and to the upper border, and what crossing it adds to the code
        border = np.concatenate([inside, 1 - inside], axis=1)
        step = np.concatenate([-self.mixers[t], self.mixers[t]])
        steps = step[np.argsort(border, axis=1, kind="stable")]
        base = (cells.astype(np.int64) * self.mixers[t]).sum(axis=1)
        sets = probe_sets(k, count)
        return base[:, None] + steps @ sets.T


def filled(index: Index, lifted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per table its buckets that hold rows, sorted, and each row's place among them."""
    return [np.unique(index.codes(lifted, t), return_inverse=True) for t in range(len(index.directions))]


def candidates(index: Index, lifted: np.ndarray, queries: np.ndarray, least: int = 0, tables: list | None = None) -> np.ndarray:
    """Which rows each query meets in a visited bucket of any table: queries x rows, boolean.

    A query that meets fewer than ``least`` rows probes on, twice as far each
    time, until it has them; after ``MOST_PROBES`` buckets of each table it
    meets all rows.
    """
    tables = tables or filled(index, lifted)
    met = _met(index, tables, queries, index.probes)
    probes, least = index.probes, min(least, len(lifted))
    while len(short := np.nonzero(met.sum(axis=1) < least)[0]):
        probes *= 2
        met[short] = True if probes > MOST_PROBES else _met(index, tables, queries[short], probes)
    return met


def _met(index: Index, tables: list, queries: np.ndarray, count: int) -> np.ndarray:
    met = np.zeros((len(queries), len(tables[0][1])), bool)
    for t, (buckets, inverse) in enumerate(tables):
        probes = index.probe_codes(queries, t, count)
        at = np.minimum(np.searchsorted(buckets, probes), len(buckets) - 1)
        visited = np.zeros((len(queries), len(buckets)), bool)
        q, p = np.nonzero(buckets[at] == probes)
        visited[q, at[q, p]] = True
        met |= visited[:, inverse]
    return met


def chance(index: Index, queries: np.ndarray, reach: np.ndarray, count: int) -> np.ndarray:
    """How likely a row at lifted distance ``reach`` lies in one of the first ``count`` buckets of some table.

    A hash moves by a normal number with the distance as its deviation,
    whatever the rows are like, so this holds for all data; nearer rows are
    likelier to be met.
    """
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    sigma = np.maximum(reach / index.width, 1e-9)[:, None]
    missed = np.ones(len(queries))
    for t in range(len(index.directions)):
        place = (unit @ index.directions[t][:, :-1].T + index.offsets[t]) / index.width
        inside = place - np.floor(place)
        # where the cell below, the own and the cell above begin and end
        below, low, high, above = (np.interp((i - inside) / sigma, _AT, _CDF) for i in (-1, 0, 1, 2))
        own = np.maximum(high - low, 1e-300)
        gain = np.log(np.maximum(np.concatenate([low - below, above - high], axis=1), 1e-300))
        gain -= np.log(np.concatenate([own, own], axis=1))
        border = np.concatenate([inside, 1 - inside], axis=1)
        gain = np.take_along_axis(gain, np.argsort(border, axis=1, kind="stable"), axis=1)
        inner = np.log(own).sum(axis=1)[:, None] + gain @ probe_sets(inside.shape[1], count).T
        missed *= 1 - np.minimum(np.exp(inner).sum(axis=1), 1)
    return 1 - missed


def widen(index: Index, tables: list, queries: np.ndarray, met: np.ndarray, reach: np.ndarray, recall: float) -> None:
    """Let each query probe on, twice as far each time, until ``chance`` is ``recall``; after the last bucket it meets all rows."""
    count, short = index.probes, np.arange(len(queries))
    while len(short := short[chance(index, queries[short], reach[short], count) < recall]):
        count *= 2
        if count > MOST_PROBES:
            met[short] = True
            break
        met[short] |= _met(index, tables, queries[short], count)


def fit(sample: np.ndarray, n_rows: int, k: int, bands: dict[int, float], recall: float = 0.96, tables: int = 8, width: float = 2.5) -> Index:
    """Choose hashes per table and probes on a bounded sample.

    The k nearest of ``n_rows`` rows are as rare as the k * sample / n_rows
    nearest of the sample (one at least, which asks for more than is needed).
    For each number of hashes, probes are what it takes until that share
    ``recall`` of those neighbours is met; of these the one that meets the
    fewest rows wins.
    """
    dimension = sample.shape[1]
    queries = sample[:SAMPLE_QUERIES]
    near = max(1, min(len(sample) - 1, math.ceil(k * len(sample) / max(n_rows, 1))))
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argsort(-score, axis=1)[:, :near] if len(sample) > 1 else np.zeros((len(queries), 1), int)
    chosen, least = None, None
    for hashes in HASHES:
        index = Index.make(dimension, tables, hashes, width, bands)
        lifted = index.rows(sample)
        first = np.full(best.shape, np.inf)
        for t in range(tables):
            codes = index.codes(lifted, t)
            probes = index.probe_codes(queries, t, MOST_PROBES)
            for q in range(len(queries)):
                same = probes[q][None, :] == codes[best[q]][:, None]
                first[q] = np.minimum(first[q], np.where(same.any(axis=1), same.argmax(axis=1), np.inf))
        need = np.sort(first.ravel())[min(first.size - 1, math.ceil(recall * first.size))]
        probes = int(min(need + 1, MOST_PROBES))
        index = Index(index.directions, index.offsets, index.mixers, width, probes, bands)
        missed = np.isinf(need)
        met = candidates(index, lifted, queries).mean()
        if chosen is None or (missed, met) < least:
            chosen, least = index, (missed, met)
    return chosen


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec array<double>)`` of the rows that take part: an id, and a finite non-zero vector."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.96) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of largest inner product that each query finds.

    Every row is indexed, in shards of about ``SHARD_ROWS`` dealt by a hash of
    its id, so no bucket, however full, is ever gathered in one place.  In a
    shard each query visits its buckets in all tables, the candidates are
    merged and ranked by the exact inner product (added up in order, in double
    precision; a matrix product rules out most before), and its k best leave as one row.  A query that meets too few
    rows of a shard probes on, so k rows are found wherever k exist.  Hash functions and first probes are
    fitted on ``SAMPLE`` rows with the smallest hash of their id; their size is
    fixed.  A query unlike the sample probes on too: the best it has met say how
    far a better row may lie, and it stops where such a row would have been met
    with a chance of ``recall``.  Buckets and candidates are never cut off.

    Rows without an id, and vectors that are NULL, zero, or hold NULL or
    non-finite components, take no part; neither do vectors of another length
    than the most frequent one.  A query is no candidate of its own.  Rows that
    share an id are one row, with their best score.  Ties go to the smaller id.
    """
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("vec") == d)
    asked = usable(queries, id_col, vec_col).where(F.size("vec") == d)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    # at most one band per exponent of a double
    bands = rows.select(norm.alias("n")).groupBy(F.rint(F.log2("n")).cast("int").alias("e")).agg(F.max("n").alias("n"))
    largest = {r["e"]: r["n"] for r in bands.collect()}
    # the two ways to add up a norm may differ in the last place and fall on the two sides of a band's border
    for e in list(largest):
        largest.setdefault(e - 1, largest[e])
        largest.setdefault(e + 1, largest[e])
    pick = F.xxhash64(F.lit("sample"), F.col("id"))
    bound = hash_bound(rows.select(pick.alias("pick")), SAMPLE)
    picked = rows.where(pick <= bound).orderBy(pick, "id", "vec").limit(SAMPLE).collect()
    index = fit(np.array([r["vec"] for r in picked]), n, k, largest, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    shards = max(1, math.ceil(n / SHARD_ROWS))
    # the most of a query's k nearest that one shard is likely to hold: mean and three deviations
    share = min(k, math.ceil(k / shards + 3 * math.sqrt(k / shards)))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    # both sides need the same types: a cogroup compares keys by the hash of their type and would lose pairs
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    one_of = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("long")
    dealt = rows.select(one_of(shards).alias("shard"), every(blocks).alias("block"), "id", "vec")
    posed = asked.select(every(shards).alias("shard"), one_of(blocks).alias("block"), "id", "vec")

    def search(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            index = shared.value
            ids, x = left["id"].to_numpy(), np.stack(left["vec"].to_numpy())
            # rows of one id lie in one shard
            repeated = 1 + len(ids) - len(np.unique(ids))
            lifted = index.rows(x)
            tables = filled(index, lifted)
            norms = np.linalg.norm(x, axis=1)
            scale = np.unique([index.bands[int(e)] for e in np.rint(np.log2(norms))])
            # twice as far as two ways to add up an inner product can lie apart, per length of the query
            doubt = 8 * x.shape[1] * np.finfo(float).eps * norms.max()

            def best_of(met: np.ndarray, near: np.ndarray, unsure: float, qid: int, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                found = np.nonzero(met & (ids != qid))[0]
                if len(found) > 4 * k:
                    floor = np.partition(near[found], -k)[-k] - unsure
                    if np.isfinite(floor):
                        found = found[near[found] >= floor]
                # one component after the other, so equal vectors get equal scores
                score = (x[found] * vector).cumsum(axis=1)[:, -1]
                best = np.lexsort((ids[found], -score))[:k]
                return found[best], score[best]

            for at in range(0, len(right), AT_ONCE):
                part = right.iloc[at : at + AT_ONCE]
                y = np.stack(part["vec"].to_numpy())
                asking = part["id"].tolist()
                # its own row is no candidate, and rows of one id are one
                met = candidates(index, lifted, y, k + repeated, tables)
                first = met.sum(axis=1)
                length = np.linalg.norm(y, axis=1)
                with np.errstate(invalid="ignore", over="ignore"):
                    near, unsure = y @ x.T, doubt * length
                best = [best_of(met[i], near[i], unsure[i], qid, y[i]) for i, qid in enumerate(asking)]
                # the lifted distance of a row as good as the last that counts, in the band where it is farthest
                last = np.array([s[share - 1] if len(s) >= share else -np.inf for _, s in best])
                with np.errstate(invalid="ignore", over="ignore"):
                    cosine = last[:, None] / (length[:, None] * scale[None, :])
                reach = np.sqrt(np.clip(2 - 2 * np.clip(cosine, -1, 1), 0, None)).max(axis=1)
                widen(index, tables, y, met, reach, recall)
                for i, qid in enumerate(asking):
                    if met[i].sum() > first[i]:
                        best[i] = best_of(met[i], near[i], unsure[i], qid, y[i])
                    if len(best[i][0]):
                        out.append((qid, ids[best[i][0]].tolist(), best[i][1].tolist()))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    pair = dealt.groupBy("shard", "block").cogroup(posed.groupBy("shard", "block"))
    part = pair.applyInPandas(search, "query_id long, ids array<long>, scores array<double>")
    part = part.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("f"))
    part = part.groupBy("query_id", F.col("f.ids").alias("vec_id")).agg(F.max("f.scores").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query("op2_nearest")
def op2_nearest(spark, sf_dir):
    vectors = cut(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
