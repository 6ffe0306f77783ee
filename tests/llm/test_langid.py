from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from flowtally.llm import langid
from flowtally.llm.langid import Tagger, clean, fit, forward_backward, held_out, op5_language_id, predict, train, word_features

SMALL = "/root/testdata/sf0.001"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4, 4, 2])
    emit, trans = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    got, at = forward_backward(emit, lengths, trans), 0
    for n in lengths:
        expected = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            score = sum(emit[at + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
            for t, y in enumerate(path):
                expected[t, y] += np.exp(score)
        expected /= expected.sum(axis=1, keepdims=True)
        assert np.allclose(got[at : at + n], expected)
        at += n


def test_long_chains_stay_finite():
    rng = np.random.default_rng(2)
    got = forward_backward(rng.normal(size=(5000, 4)) * 30, np.array([5000]), rng.normal(size=(4, 4)) * 5)
    assert np.isfinite(got).all() and np.allclose(got.sum(axis=1), 1)


def test_features_do_not_depend_on_the_batch():
    words = ["a", "straße", "été", "nonsense", "x" * 300]
    ids, who = word_features(words)
    for i, w in enumerate(words):
        assert sorted(ids[who == i]) == sorted(word_features([w])[0])
    assert [clean(t) for t in ("Hello,", "##", "1a2", "(b)", "É.")] == ["hello", "", "a", "b", "é"]


def test_code_switched_words_get_their_own_label():
    en, de = "the of and thing other with from they have this".split(), "der und nicht werden eine keit schaft über sich auch".split()
    rng = np.random.default_rng(0)
    samples = [("en", list(rng.choice(en, 48))) for _ in range(60)] + [("de", list(rng.choice(de, 48))) for _ in range(60)]
    crf = train(samples)
    words = en[:8] + de[:8]
    marg = forward_backward(crf.emissions(words), np.array([len(words)]), crf.transitions)
    assert [crf.labels[i] for i in marg.argmax(axis=1)] == ["en"] * 8 + ["de"] * 8
    # staying in a language is likelier than leaving it
    assert crf.transitions[0, 0] > crf.transitions[0, 1] and crf.transitions[1, 1] > crf.transitions[1, 0]


def test_held_out_accuracy(spark):
    rows = op5_language_id(spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(held) > 20
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    crf = fit(docs.where(~held_out()))
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "12 34 !? \n ::", 0.5), (None, "the of and", 0.5), (5, "the of and " * 30000, 0.5), (5, "x" * 100000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("lang_pred", F.lit("zz"))
    out = predict(df, crf)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3
    assert got[3].lang_pred == "en" and got[4].lang_pred == "en" and got[4].score > 0.9
    assert predict(df.where("1 = 0"), crf).collect() == []
    empty = fit(docs.where("1 = 0"))
    assert {(r.lang_pred, r.score) for r in predict(df, empty).collect()} == {("und", 0.0)}
    assert [r.h for r in df.select(held_out().alias("h")).where("doc_id IS NULL").collect()] == [False]


def test_groups_do_not_change_the_result(monkeypatch):
    crf = train([("en", "the of and other thing".split() * 5), ("fr", "les des une est pour".split() * 5)])
    texts = ["the other thing of\nles des une", "", "est pour les " * 50]
    whole = Tagger(crf).predict(texts)
    monkeypatch.setattr(langid, "GROUP", 5)
    monkeypatch.setattr(langid, "KEPT", 3)
    langs, scores = Tagger(crf).predict(texts)
    assert langs == whole[0] and np.allclose(scores, whole[1])


def test_clashing_names_are_carried(spark):
    crf = train([("en", ["the", "thing"]), ("de", ["der", "keit"])] * 5)
    df = spark.createDataFrame([("the thing", 1, 2, 3)], ["text", "tag", "_tag", "a.b"])
    out = predict(df, crf)
    assert out.columns == [*df.columns, "lang_pred", "score"]
    assert tuple(out.first())[:5] == ("the thing", 1, 2, 3, "en")


def test_new_words_are_learned_in_small_parts(monkeypatch):
    samples = [("de", "der und die nicht ist".split()), ("en", "the and of not is".split())] * 20
    crf = train(samples, epochs=2)
    texts = [" ".join(f"wort{i} {i} word{i * j}" for i in range(40)) for j in range(3)]
    want = Tagger(crf).predict(texts)
    sizes = []
    plain = langid.Crf.emissions
    monkeypatch.setattr(langid.Crf, "emissions", lambda self, words: sizes.append(len(words)) or plain(self, words))
    monkeypatch.setattr(langid, "LEARNED", 7)
    assert Tagger(crf).predict(texts) == want
    assert max(sizes) == 7 and sum(sizes) >= 100
