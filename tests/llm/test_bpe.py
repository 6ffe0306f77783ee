from __future__ import annotations

import base64
import hashlib
import random

import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from flowtally.llm import bpe
from flowtally.llm.bpe import decode, digests, encode, fold, fold_words, load_ranks, op3_byte_bpe, rank_literal, vocabulary

SMALL = "/root/testdata/sf0.001"
PATH, PATTERN = vocabulary()
RANKS = load_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 2, 7, 48, 49, 50, 400, 5000])
def test_fold_equals_library(library, size):
    rnd = random.Random(size)
    for alphabet in ("ab", "abcdethüé", "aeiouß漢字", "x"):
        word = "".join(rnd.choice(alphabet) for _ in range(size))
        if len(regex.findall(PATTERN, word)) == 1:
            assert list(fold(word.encode(), RANKS)) == library.encode_ordinary(word)


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op3_byte_bpe(spark, SMALL).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


TEXTS = [None, "", " ", "\n\n  a\t b", "I'll we've 'S 's", "<|endoftext|>", "漢字 🙂 é𝒳 x　y", "a" * 60000, " " * 5000 + "x", "1234567 ½ ²", "same", "same"]


def test_edges_round_trip(spark, library):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    coded = encode(df, PATH, PATTERN)
    assert coded.columns == ["doc_id", "ids"]
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in decode(coded, PATH).collect()}
    assert got == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(TEXTS)}
    out = digests(df, PATH, PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: r.ids_sha256 for r in out.collect()} == {i: sha(",".join(map(str, ids))) for i, (ids, _) in got.items()}
    assert digests(df.where("1 = 0"), PATH, PATTERN).collect() == []


def test_small_groups_and_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "SHORT", 2)
    for word in ("tokenization", "Straßenbahn", "aaaaaaa"):
        assert list(fold(word.encode(), RANKS)) == library.encode_ordinary(word)


def test_higher_order_fold_equals_library(spark, library):
    words = ["", "a", " the", "été", "Straßen", None, " zq", "aaaaa"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = fold_words(df, rank_literal(spark, PATH))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r.word: r.ids for r in got.collect()} == {w: None if w is None else library.encode_ordinary(w) for w in words}


def test_unknown_id_fails(spark):
    df = spark.createDataFrame([([10**6],)], "ids array<int>")
    with pytest.raises(Exception, match="KeyError"):
        decode(df, PATH).collect()
    assert decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).select(F.col("decoded")).collect()[0][0] is None


def test_round_trip_runs_in_one_worker_a_task(spark, monkeypatch):
    texts = [(1, "ab  cd\n" * 40, 5), (2, None, 6), (3, "", 7), (4, "größe 漢字", 8), (None, "x", None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, coded int").coalesce(1)
    monkeypatch.setattr(bpe, "ROWS", 2)
    got = bpe.round_trip(docs, PATH, PATTERN)
    want = decode(encode(docs, PATH, PATTERN), PATH)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = digests(docs, PATH, PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_many_words_fold_together(library, monkeypatch):
    rnd = random.Random(5)
    words = ["", "x", "aaaaaaa", *("".join(rnd.choice(a) for _ in range(rnd.randrange(1, 16))) for a in ("abcdethü", "aeiouß漢字", "th e") * 300)]
    got = bpe.fold_many([w.encode() for w in words], PATH)
    assert got == [list(fold(w.encode(), RANKS)) for w in words]
    assert bpe.fold_many([], PATH) == []

    def one_by_one(word, ranks):
        raise AssertionError(word)

    monkeypatch.setattr(bpe, "GROUP", 7)
    monkeypatch.setattr(bpe, "fold", one_by_one)
    texts = [None, "", "the tokenization of Straßenbahn 漢字 and so on, " * 3, "a", "I'll we've " * 9]
    ids = bpe._encoder(PATH, PATTERN)(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [library.encode_ordinary(t or "") for t in texts]


def test_bytes_without_a_rank_may_be_halves_of_a_piece(tmp_path):
    path = tmp_path / "some.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % r for r, p in enumerate((b"a", b"b", b"cd", b"bcd"))))
    assert bpe.fold_many([b"acd", b"abcd", b"ab"], str(path)) == [[0, 2], [0, 3], [0, 1]]
