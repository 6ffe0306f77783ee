from __future__ import annotations

import itertools
import random

import pytest
import xxhash

from flowtally.llm import simhash
from flowtally.llm.components import components
from flowtally.llm.simhash import covering_masks, fingerprint, near_links, op4_simhash, simhash_groups

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest id reachable over links of at most two bits; ``prints`` maps id to fingerprint."""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {i: find(i) for i in prints}


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = covering_masks(radius)
        for bits in itertools.combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "É a\x0bb\xa0c d e", "x y " * 400])
def test_fingerprint_equals_plain(text):
    assert fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    rows = op4_simhash(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_groups({i: plain_fingerprint(t) for i, t in texts.items()})


@pytest.mark.parametrize("bucket", [1, 2, 32])
def test_links_join_what_brute_force_joins(spark, bucket):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(3)]
    prints = set(base)
    while len(prints) < 120:  # chains of near fingerprints, so buckets are full
        prints.add(rnd.choice(sorted(prints)) ^ (1 << rnd.randrange(12)) ^ (1 << rnd.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    table = spark.createDataFrame([(p, p) for p in signed], "fp long, id long")
    got = {r.node: r.component for r in components(near_links(table, 2, bucket)).collect()}
    expected = plain_groups({p: p & (2**64 - 1) for p in signed})
    assert {p: got.get(p, p) for p in signed} == expected


def test_null_empty_repeated_and_clashing(spark):
    same = "alpha beta gamma delta epsilon"
    rows = [(5, same, 1), (3, same, 2), (3, same, 2), (None, same, 3), (9, None, 4), (8, "", 5), (None, "lone text without company here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnsRenamed({"fp": "component_id"})
    got = sorted((r.id, r.component_id) for r in simhash_groups(df).collect() if r.id is not None)
    assert got == [(3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert sorted(map(str, (r.component_id for r in simhash_groups(df).where("id IS NULL").collect()))) == ["3", "None"]
    assert simhash_groups(df.where("1 = 0")).collect() == []


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)}
    assert components(df.where("1 = 0")).collect() == []


def test_long_text_is_counted_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert fingerprint(text) == whole
