from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.llm.filter_audit import audit, mask_cells, op13_filter_audit, report, text_failures, walk
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


def plain(docs, labels):
    """The audit by applying every order document by document; rows are (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    low = {}
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > low[text],
        }
        parts[lang or ""].append((i, fails))
    out = []
    for part, members in parts.items():
        total = defaultdict(int)
        some = []
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                kept = [m for m in left if not m[1][f]]
                gone = [m for m in left if m[1][f]]
                total[f] += len(gone)
                redundant = sum(m[1][f] for m in members) - len(gone)
                alone = sum(sum(m[1].values()) == 1 and m[1][f] for m in members)
                some.append((part, order, step, f, len(kept), len(gone), redundant, alone, sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)))
                left = kept
        out += [(*r, total[r[3]]) for r in some]
    return sorted(out, key=lambda t: tuple((v is not None, str(v)) for v in t))


def run(docs, labels):
    return rows(audit(mask_cells(docs, text_failures(), labels, duplicate="E"), "ABCDE"))


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows(op13_filter_audit(spark, SMALL)) == plain(docs, labels)


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    long = "wörd WORD $ " * 60_000
    docs = [
        (4, "same", "en"), (2, "same", "de"), (2, "same", "de"), (2, "same", "en"), (None, "same", "en"), (9, "same", None),
        (5, None, None), (6, "", None), (7, " \n ", "en"), (8, long, "en"), (3, long, "de"), (1, "ABC " * 300, "en"), (10, "a#", ""),
    ]
    labels = [(2, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (8, 1, 1), (9, 1, None), (77, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, lang string, part int, mask int, n int")
    marks = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, id int")
    assert run(frame, marks) == plain(docs, labels)
    assert run(frame, marks.where("1 = 0")) == plain(docs, [])
    assert run(frame.where("1 = 0"), marks) == []


@pytest.mark.parametrize("n", [1, 3, 5])
def test_walk_equals_direct_sums(n):
    cells = np.random.default_rng(n).integers(0, 50, (1 << n, 3))
    states = walk(cells, n)
    for s in range(1 << n):
        assert (states[s] == sum(cells[m] for m in range(1 << n) if not m & s)).all()
    made = report(cells, "ABCDE"[:n])
    assert len(made) == n * len(list(permutations(range(n))))
    assert sum(r[4] for r in made if r[0] == made[0][0]) == cells[1:, 0].sum()


def test_copies_fold_before_the_shuffle(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {r["mask"]: r["n"] for r in mask_cells(docs, text_failures(), labels, duplicate="E").collect()}
    assert cells == {1: 1, 17: 999}


def test_without_a_duplicate_filter(spark):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "x", "en"), (3, "$", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    cells = mask_cells(docs, {"D": F.col("text").rlike("[$]")}, labels)
    assert rows(cells) == [("", 1, 1, 0, 0), ("en", 0, 2, 1, 0)]
    assert len(audit(cells, "D").collect()) == 2
