"""What each filter of a cleaning chain removes in any order, by a Gray-code walk over the filter subsets."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.lineage import cut
from flowtally.llm.base import SPACE, query, table, words_of

COUNTS = ("n", "good", "toxic")
SCHEMA = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def walk(cells: np.ndarray, n_filters: int) -> np.ndarray:
    """Survivors of every filter subset: row s is the column sums of ``cells`` over the masks that meet no filter of s.

    ``cells`` has one row per failure mask.  The subsets come in Gray-code
    order, so one filter is switched on or off at a time.  Every mask cell
    keeps the number of active filters it fails; it leaves the running
    survivors when that number rises from 0 and returns when it falls to 0.
    """
    size = 1 << n_filters
    masks = np.arange(size)
    failing = np.zeros(size, np.int64)
    states = np.zeros((size, cells.shape[1]), np.int64)
    survivors = cells.sum(axis=0)
    states[0] = survivors
    subset = 0
    for step in range(1, size):
        f = (step & -step).bit_length() - 1
        subset ^= 1 << f
        touched = masks >> f & 1 == 1
        if subset >> f & 1:
            survivors = survivors - cells[touched & (failing == 0)].sum(axis=0)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            survivors = survivors + cells[touched & (failing == 0)].sum(axis=0)
        states[subset] = survivors
    return states


def report(cells: np.ndarray, letters: str) -> list[tuple]:
    """One row per order and step, out of differences of the stored states."""
    n = len(letters)
    states = walk(cells, n)
    every = (1 << n) - 1
    fails = [int(states[0, 0] - states[1 << f, 0]) for f in range(n)]
    alone = [int(states[every ^ (1 << f), 0] - states[every, 0]) for f in range(n)]
    # a subset of k filters stands before f in k! (n - 1 - k)! orders
    shapley = [
        sum(
            factorial(k := s.bit_count()) * factorial(n - 1 - k) * int(states[s, 0] - states[s | 1 << f, 0])
            for s in range(1 << n)
            if not s >> f & 1
        )
        for f in range(n)
    ]
    rows = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            lost = states[before] - states[after]
            name = "".join(letters[i] for i in order)
            gone = int(lost[0])
            rows.append((name, step, letters[f], int(states[after, 0]), gone, fails[f] - gone, alone[f], int(lost[1]), int(lost[2]), shapley[f]))
            before = after
    return rows


def mask_cells(
    docs: DataFrame,
    failures: Mapping[str, Column],
    labels: DataFrame,
    *,
    duplicate: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows of each part by the set of filters they fail.

    Bit i of the mask is the i-th key of ``failures``, a condition on the
    column ``text``; NULL counts as not failing.  With ``duplicate`` one more
    bit follows: the text equals that of a smaller id anywhere in the table.
    NULL text is empty, a NULL part is the empty string.  Repeated rows count
    each; those of one id are not each other's duplicates.  Rows with a NULL id
    neither are duplicates nor make any, and have no labels.  A document is
    good or toxic if any of its label rows says so.  Only these columns are
    read, whatever else the tables hold.

    Texts travel as digests.  All copies of a text in one part are one row per
    task and set of labels before the shuffle, so no group of copies meets in
    one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    bits = F.lit(0)
    for i, failed in enumerate(failures.values()):
        bits = bits + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    digest = F.unhex(F.sha2("text", 256)) if duplicate else F.lit(None).cast("binary")
    d = d.select("id", "part", digest.alias("digest"), bits.cast("int").alias("mask"))

    def flag(name):
        return F.max((F.col(name) == 1).cast("int")).alias(name)

    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(flag("quality"), flag("toxic")).where("quality = 1 OR toxic = 1")
    d = d.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    kinds = ["part", "mask", "quality", "toxic"]
    if duplicate:
        # repeated rows of an id fold first, so that the lowest id of a text stands for all its rows
        d = d.groupBy("id", "digest", *kinds).agg(F.count(F.lit(1)).alias("c"))
        unknown = F.col("id").isNull()
        texts = d.groupBy("digest", *kinds).agg(
            F.sum("c").alias("n"),
            F.sum(F.when(unknown, F.col("c"))).alias("unknown"),
            F.min(F.when(~unknown, F.struct("id", "c"))).alias("low"),
        )
        lowest = F.min("low.id").over(Window.partitionBy("digest"))
        first = F.when(F.col("low.id") == lowest, F.col("low.c")).otherwise(F.lit(0)) + F.coalesce("unknown", F.lit(0))
        texts = texts.withColumn("first", first)
        both = F.array(
            F.struct(F.col("mask").alias("m"), F.col("first").alias("c")),
            F.struct((F.col("mask") + (1 << len(failures))).alias("m"), (F.col("n") - F.col("first")).alias("c")),
        )
        d = texts.select("part", "quality", "toxic", F.explode(both).alias("x")).select("part", "quality", "toxic", F.col("x.m").alias("mask"), F.col("x.c").alias("c"))
        d = d.where("c > 0")
    else:
        d = d.withColumn("c", F.lit(1).cast("long"))
    return d.groupBy("part", "mask").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("quality") == 1, F.col("c")).otherwise(F.lit(0))).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("c")).otherwise(F.lit(0))).alias("toxic"),
    )


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """``SCHEMA``: one row per part, order of the filters and step.

    A part is one row of at most 2^filters cells, so each task walks its own
    parts and keeps one part's states at a time.  No cells give no rows.
    """
    size = 1 << len(letters)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def rows(batches):
        for batch in batches:
            for part, found in zip(batch["part"], batch["cells"], strict=True):
                grid = np.zeros((size, len(COUNTS)), np.int64)
                for c in found:
                    grid[c["mask"]] += [c[x] for x in COUNTS]
                yield pd.DataFrame([(part, *r) for r in report(grid, letters)], columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return parts.mapInPandas(rows, SCHEMA)


def text_failures() -> dict[str, Column]:
    """Filters A to D over ``text``: short, repetitive, many capitals, marks of markup."""
    words = words_of(F.col("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^{SPACE}]+') AS words,
             min(doc_id) OVER (PARTITION BY text) AS low FROM d),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
             CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN g USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order,
             [0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, 31 - e.bit] AS befores, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(befores) AS before, unnest(bits) AS bit FROM o),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN bad ELSE 0 END) AS toxic_lost
      FROM cells, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, x AS "filter", kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r JOIN f USING (bit)
"""


@query("op13_filter_audit", OP13_SQL)
def op13_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cells = mask_cells(docs, text_failures(), table(spark, sf_dir, "labels"), duplicate="E")
    return audit(cut(cells), "ABCDE")
