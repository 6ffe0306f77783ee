from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import Row

import corpus_pipeline as pipeline
from flowtally.llm.bpe import load_ranks, vocabulary
from flowtally.llm.secrets import scan_new
from tests.llm.test_simhash import plain_fingerprint, plain_groups

SMALL = "/root/testdata/sf0.001"
PLANTED = 900_000


@pytest.fixture(scope="module")
def tables(spark):
    """The input and the result of each stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # the small table holds no secrets: plant some in texts of its own words, turned round so that they are no copies
    some = [r for r in docs.where("n_chars > 400 AND lang = 'en'").orderBy("doc_id").limit(3).collect()]
    secrets = ["password = hunter2-hunter2", "AKIA" + "Q7" * 8, "0123456789abcdef" * 3]
    planted = []
    for i, (r, secret) in enumerate(zip(some, secrets, strict=True)):
        words = r.text.split()[::-1]
        text = " ".join([*words[:20], secret, *words[20:]])
        planted.append(Row(**{**r.asDict(), "doc_id": PLANTED + i, "text": text, "n_chars": len(text)}))
    out = [docs.union(spark.createDataFrame(planted, docs.schema))]
    for _, stage in pipeline.STAGES:
        rows = stage(spark, out[-1], SMALL)
        made = spark.createDataFrame(rows.collect(), rows.schema)
        out.append(made)
    return [t.collect() for t in out], out


def test_language_keeps_clean_documents(spark, tables):
    rows, _ = tables
    assert len(rows[1]) >= 0.99 * len(rows[0])
    odd = spark.createDataFrame([(-1, "1 2 3", "en", "s", 5), (-2, None, None, None, None)], tables[1][0].schema)
    kept = pipeline.language(spark, tables[1][0].union(odd), SMALL)
    assert kept.where("doc_id < 0").count() == 0


def test_one_document_of_each_group_stays(tables):
    rows, _ = tables
    groups = plain_groups({r.doc_id: plain_fingerprint(r.text) for r in rows[1]})
    assert sorted(r.doc_id for r in rows[2]) == sorted(set(groups.values()))


def test_secrets_go_and_documents_stay(spark, tables):
    rows, frames = tables
    assert sorted(r.doc_id for r in rows[3]) == sorted(r.doc_id for r in rows[2])
    planted = {r.doc_id: r.text for r in rows[3] if r.doc_id >= PLANTED}
    assert len(planted) == 3 and not any(s in t for t in planted.values() for s in ("hunter2", "AKIA", "0123456789"))
    assert scan_new(frames[2])[0].count() >= 3 and scan_new(frames[3])[0].count() == 0
    assert all(r.n_chars == len(r.text) for r in rows[3])


def test_mixing_repeats_small_sources_and_drops_nothing(tables):
    rows, _ = tables
    copies = Counter(r.doc_id for r in rows[4])
    assert set(copies) == {r.doc_id for r in rows[3]} and max(copies.values()) == 2
    have, used = Counter(), Counter()
    for r in rows[3]:
        have[r.source] += len(r.text.split())
    for r in rows[4]:
        used[r.source] += len(r.text.split())
    largest = max(have, key=have.get)
    assert used[largest] == have[largest]
    assert max(used.values()) / min(used.values()) < max(have.values()) / min(have.values())


def test_tokens_equal_library(tables):
    rows, _ = tables
    path, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in rows[4]}
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_stages_return_the_columns_of_documents(tables):
    _, frames = tables
    assert all(f.columns == frames[0].columns for f in frames[:-1])


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, "the thing of that and other " * 20, "en", "a", 1), (1, "the thing of that and other " * 20, "en", "a", 1), (2, None, None, None, None)]
    rows += [(None, "und nicht der die keit schaft " * 20, "de", None, 3), (4, "", "en", "a", 0)]
    rows += [(i, f"the of and thing {i} with words other {i * i} that", "en", "b", 9) for i in range(10, 30)]
    rows += [(i, f"der und nicht {i} keit eine schaft {i * i} auch", "de", "c", 9) for i in range(30, 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) == {1, None, *range(10, 50)}
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    assert pipeline.run(spark, str(empty)).collect() == []


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(3, b, 0), (5, a, 1), (5, b, 2), (5, a, 3), (None, c, 4), (None, c, 5), (None, a, 6), (None, "one two", 7), (5, c + " x y z", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    kept = pipeline.near_duplicates(spark, df, None)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, b), (5, a), (None, "one two"), *plain_choice([(None, c), (5, c + " x y z")])], key=str
    )


def plain_choice(pair):
    """Both texts if their fingerprints differ in more than two bits, else that with an id."""
    near = bin(plain_fingerprint(pair[0][1]) ^ plain_fingerprint(pair[1][1])).count("1") <= 2
    return pair[1:] if near else pair
