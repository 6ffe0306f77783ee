from __future__ import annotations

import hashlib
import random
import uuid
from collections import defaultdict

import numpy as np
import pytest

from flowtally.llm import repeats
from flowtally.llm.repeats import anchors, factor_flags, gram_hashes, op7_repeats, remove_repeats

SMALL = "/root/testdata/sf0.001"


def plain(texts, length, first_only=False, key=lambda i, t: i):
    """Kept bytes and number of removed runs per text, from all windows."""
    where = defaultdict(set)
    for i, t in enumerate(texts):
        for at in range(len(t) - length + 1):
            where[t[at : at + length]].add((key(i, t), at))
    out = []
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for at in range(len(t) - length + 1):
            places = where[t[at : at + length]]
            if len(places) > 1 and not (first_only and min(places) == (key(i, t), at)):
                gone[at : at + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), len([r for r in bytes(gone).split(b"\0") if r])))
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    expected = plain([r.text.encode() for r in docs], 200)
    got = {r.doc_id: r for r in op7_repeats(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r, (kept, runs) in zip(docs, expected, strict=True):
        g = got[r.doc_id]
        n = len(r.text.encode())
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (n, n - len(kept), runs, hashlib.sha256(kept).hexdigest())


def made_texts():
    rnd = random.Random(11)

    def noise(n):
        return "".join(rnd.choice("abcdefgh é") for _ in range(n))

    shared = [noise(90) for _ in range(4)]
    texts = [noise(rnd.randrange(200)) + rnd.choice(shared)[rnd.randrange(20) :] + noise(rnd.randrange(80)) for _ in range(60)]
    texts += [shared[0] * 4, "x" * 500, "ab" * 200, "", "short", texts[0], texts[0], noise(60) + texts[3] + noise(10)]
    return texts


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("large", [8192, 2])
def test_made_texts_equal_brute_force(spark, monkeypatch, keep_first, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    texts = made_texts()
    df = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(texts)], "doc_id long, text string, t int, spans string")
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(df, ["doc_id", "t"], length=48, keep_first=keep_first).collect()}
    coded = [t.encode() for t in texts]
    if keep_first:
        # equal texts are one text, so their copies are judged alike
        expected = plain(coded, 48, True, lambda i, t: repeats._digest(t))
    else:
        expected = plain(coded, 48)
    assert got == {i: kept for i, (kept, _) in enumerate(expected)}


def test_nulls_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(None, None), (1, None), (2, "z" * 30), (3, "q" * 40), (3, "q" * 40)], "doc_id long, text string")
    out = remove_repeats(df, ["doc_id"], length=40, keep_first=False).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, len(r.removed)) for r in out) == [
        (0, 0, 0, 0),
        (1, 0, 0, 0),
        (2, 30, 0, 0),
        (3, 40, 40, 1),
        (3, 40, 40, 1),
    ]
    assert remove_repeats(df.where("1 = 0"), ["doc_id"]).collect() == []


def test_anchors_are_chosen_by_content(monkeypatch):
    rnd = random.Random(2)
    text = bytes(rnd.choice(b"abc ") for _ in range(3000))
    place, hashes, first = anchors(text, 100)
    h = gram_hashes(np.frombuffer(text, np.uint8)) >> np.uint64(21)
    windows = len(text) - 100 + 1
    chosen = [s + int(np.argmin(h[s : s + 100 - repeats.GRAM + 1])) for s in range(windows)]
    spread = np.repeat(place, np.diff(np.append(first, windows)))
    assert spread.tolist() == chosen
    monkeypatch.setattr(repeats, "BLOCK", 256)
    again = anchors(text, 100)
    assert all((a == b).all() for a, b in zip(again, (place, hashes, first), strict=True))


def test_flags_tell_earlier_from_any_copy():
    p = b"0123456789" * 3
    parts = [b"aa" + p, p + b"bb", b"c" * 30]
    earlier, anywhere = factor_flags(parts, np.array([0, 1, 2]), np.array([0, 0, 0]), np.array([1, 1, 1]), 28)
    assert not earlier[0].any() and np.nonzero(anywhere[0])[0].tolist() == [2, 3, 4]
    assert np.nonzero(earlier[1])[0].tolist() == [0, 1, 2]
    # a run of one letter repeats itself at the next place
    assert np.nonzero(anywhere[2])[0].tolist() == [0, 1, 2] and np.nonzero(earlier[2])[0].tolist() == [1, 2]


def test_anchors_are_made_once(spark, tmp_path):
    passage = "".join(chr(97 + i * i % 23) for i in range(300))
    plain = spark.createDataFrame([(f"{i} " * 50 + passage,) for i in range(4)], "text string").coalesce(1)

    def read(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    spans = repeats.repeated_spans(plain.mapInArrow(read, "text string"), length=100, keep_first=False)
    assert spans.count() == 4
    # once for the anchors, once for the texts that hold repeated ones
    assert len(list(tmp_path.iterdir())) == 2
