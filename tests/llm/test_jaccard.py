from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from flowtally.llm import jaccard
from flowtally.llm.jaccard import BANDS, allocate, band_of, budget, jaccard_groups, op12_jaccard_join, probed, segments, shingle_set, signatures

SMALL = "/root/testdata/sf0.001"


def plain_set(text, size=5):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_groups(texts, size=5, percent=80):
    """id -> (set size, smallest id reachable), by comparing all pairs."""
    sets = {i: plain_set(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


def run(spark, texts, **options):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(frame, **options).collect()}


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op12_jaccard_join(spark, SMALL).collect()}
    assert got == plain_groups(texts)
    assert max(Counter(c for _, c in got.values()).values()) > 1


def edited(words, rnd, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        kind = rnd.randrange(3)
        if kind == 0:
            words[at] = f"new{rnd.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"new{rnd.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_hubs_and_passages_equal_brute_force(spark, seed):
    """Texts around the threshold: near copies of a base, drifting versions, and a passage all share."""
    rnd = random.Random(seed)
    texts = {}
    passage = [f"common{i}" for i in range(60)]
    base = [f"base{i}" for i in range(200)]
    version = [f"drift{i}" for i in range(120)]
    for i in range(60):
        texts[len(texts)] = " ".join(edited(base, rnd, rnd.randrange(8)))
        version = edited(version, rnd, 2)
        texts[len(texts)] = " ".join(version)
        own = [f"own{i}x{j}" for j in range(rnd.choice([3, 8, 16, 40]))]
        texts[len(texts)] = " ".join(passage + own)
        texts[len(texts)] = " ".join(f"s{rnd.randrange(3)}" for _ in range(rnd.randrange(12)))
        texts[len(texts)] = " ".join(f"few{j}" for j in range(rnd.randrange(4, 14)))
    ids = list(texts)
    rnd.shuffle(ids)
    texts = dict(zip(ids, texts.values(), strict=True))
    assert run(spark, texts) == plain_groups(texts)


def test_other_thresholds_and_shingles(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(edited(base, rnd, rnd.randrange(12))) for i in range(70)}
    assert run(spark, texts, shingle=2, percent=60) == plain_groups(texts, 2, 60)


def test_nulls_blanks_repeats_long_texts_and_clashing_names(spark):
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [
        (4, "Same words in all of these rows"), (2, "same  WORDS in all\nof these rows"), (2, "same words in all of these rows"),
        (None, "same words in all of these rows"), (None, "a text that nobody else has at all"), (7, None), (8, ""), (6, " \n"),
        (9, long), (5, long + " end"), (1, "x " * 3000), (3, "x x x x x"), (10, "ONE two"), (11, "one TWO"), (12, "one two three"),
    ]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, cls int, n int, component int")
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_groups(frame).collect()), key=str)
    want = [
        (4, 3, 2), (2, 3, 2), (2, 3, 2), (None, 3, 2), (None, 4, None), (7, 0, 7), (8, 0, 8), (6, 0, 6), (9, 59_996, 5), (5, 59_997, 5),
        (1, 1, 1), (3, 1, 1), (10, 1, 10), (11, 1, 10), (12, 1, 12),
    ]
    assert got == sorted(want, key=str)
    assert jaccard_groups(frame.where("1 = 0")).collect() == []


def test_two_units_of_budget_find_every_pair():
    """Whatever the neighbours, the rows looked up by the larger set meet the smaller one's indexed rows."""
    rnd = np.random.default_rng(4)
    for n in (4, 5, 6, 9, 13, 30, 80, 260):
        for _ in range(40):
            x = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            y = x
            while True:  # edit while the two stay similar
                z = y[rnd.permutation(len(y))]
                z = z[1:] if rnd.random() < 0.5 else np.append(z, rnd.integers(0, 2**63, 1).astype(np.uint64))
                common = len(np.intersect1d(x, z))
                if 100 * common < 80 * (n + len(z) - common):
                    break
                y = np.sort(z)
            if np.array_equal(x, y):
                continue
            small, large = sorted((x, y), key=len)
            below = next(i for i, b in enumerate(probed(len(large), 80)) if b == band_of(len(small)))
            mine = [(int(k), int(m)) for k, m in zip(*signatures(small, 80), strict=True) if not m & 30]
            index = {(k, m & 1) for k, m in mine}
            # neighbours at random stand for other sets, so that the allocation varies
            rows = []
            for k, m in zip(*signatures(large, 80), strict=True):
                whole, less = int(rnd.integers(0, 9)), int(rnd.integers(0, 9))
                whole, less = whole + ((int(k), 0) in index), less + ((int(k), 1) in index)
                rows.append((int(k), int(m), whole, 0 if m & 1 else less))
            rows = [r for r in rows if r[2] or r[3]]
            modes, _ = allocate(rows, 80)
            hit = False
            for r, mode in modes.items():
                k, m, _, _ = rows[r]
                if (m >> 1 & 15) == below:
                    hit |= (k, 0) in index or (mode == 1 and (k, 1) in index)
            assert hit


def test_bands_cover_all_sizes_and_partners():
    assert BANDS[0] == (1, 1) and all(b[0] == a[1] + 1 for a, b in zip(BANDS, BANDS[1:], strict=False))
    for n in range(1, 400):
        for s in range(1, n + 1):
            common = min(s, n)
            # the closest sets of these sizes: one within the other
            if 100 * common >= 80 * n and s < n:
                assert band_of(s) in probed(n, 80)
                assert n - s <= budget(n, band_of(s), 80) < segments(band_of(s), 80)[0]


def test_rarest_segments_are_paid_for_first():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64))
    rows = [(int(k), int(m), 1000 if (m >> 5 & 0xFFFFFFF) % 5 == 0 else 1, 0) for k, m in zip(*signatures(h, 80), strict=True) if not m & 31]
    modes, weight = allocate(rows, 80)
    paid = [rows[r][2] for r in modes]
    assert weight == sum(r[2] for r in rows) and paid.count(1) == sum(r[2] == 1 for r in rows)
    # nothing shared, nothing looked up
    assert allocate(rows[: len(rows) // 20], 80)[0] == {}


def test_shingle_hashes_follow_equality():
    texts = ["a b c d e", "a b c d e f", "A B\tc d E", "a b c", "a b  c", "a bc", "", "a a a a a a a"]
    for s, t in itertools.product(texts, texts):
        same = np.array_equal(shingle_set(s.encode(), 5, jaccard._Hashes()), shingle_set(t.encode(), 5, jaccard._Hashes()))
        assert same == (plain_set(s) == plain_set(t))


def test_sets_of_many_texts_at_once(monkeypatch):
    rnd = random.Random(3)
    words = ["a", "B", "été", "\x1c", "x" * 64, "x" * 65, "y" * 200, "word,", "漢字"]
    texts = [None, "", " \n", *(" \t\n"[i % 3].join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) for i in range(60))]
    raw = [t if t is None else t.encode() for t in texts]
    got = [h.tolist() for h in jaccard.shingle_sets(raw, 5, jaccard._Hashes())]
    for t, h in zip(raw, got, strict=True):
        w = (t or b"").lower().split()
        n = min(5, len(w))
        assert len(h) == len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else ()) and h == sorted(set(h))
    assert got == [shingle_set(t, 5, jaccard._Hashes()).tolist() for t in raw]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    assert got == [h.tolist() for h in jaccard.shingle_sets(raw, 5, jaccard._Hashes())]
