"""Text quality features and learned decision lists."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.lineage import cut
from flowtally.llm.base import SPACE, query, table, words_of

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def _without(text, chars: str):
    """Bytes of ``text`` that are one of the ASCII ``chars``."""
    gone = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    total = gone[0]
    for g in gone[1:]:
        total = total + g
    return total.cast("long")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the base counts and the shares the rules look at.

    Counts of whole texts, computed inside the row: repeated three-word windows
    are found by sorting the windows' 64-bit hashes, so a text of n words costs
    n log n.  NULL text counts as empty.  Columns of ``docs`` with the names of
    the new ones are replaced.
    """
    # a lateral step each, so that arrays are made once per row
    d = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).drop(text_col)
    d = d.withColumn("_words", words_of(F.col("_text")))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    d = d.withColumn("n_symbols", _without(F.col("_text"), SYMBOLS))
    d = d.withColumn("n_lines", F.size("_lines").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    d = d.withColumn("n_marks", _without(F.col("_text"), "!?"))
    d = d.withColumn("n_upper", F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long"))
    words = F.col("_words")
    last = F.col("n_words").cast("int") - 3
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_windows", windows).drop("_text", "_lines")
    ordered = F.sort_array("_windows")
    d = d.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # texts with a repeated window: its places are neighbours once windows are sorted with their places
    placed = F.sort_array(F.transform(F.col("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_placed", F.when(F.col("_twice"), placed)).drop("_windows", "_words", "_twice")
    p = F.col("_placed")
    again = F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]) | F.lit(False))
    d = d.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_placed")
    a = F.col("_again")
    # each window covers three words, fewer if the next one begins sooner
    covered = F.aggregate(
        F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_again")
    del ordered
    chars = F.greatest("word_chars", F.lit(1))
    return d.withColumns(
        {
            "word_length": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
            "symbol_share": F.col("n_symbols") / chars,
            "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
            "upper_share": F.col("n_upper") / chars,
            "mark_share": F.col("n_marks") / chars,
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


def _and(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """Bad and good rows that pass each test, in one pass: one row per test and task travels."""
    hits = rows.select("bad", F.posexplode(F.array(*tests)).alias("i", "hit")).where("hit")
    sums = hits.groupBy("i").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    out = [(0, 0)] * len(tests)
    for r in sums:
        out[r["i"]] = (int(r["p"]), int(r["n"]))
    return out


def learn_list(
    labelled: DataFrame,
    names: tuple[str, ...] = FEATURES,
    precision: float = 0.95,
    least: int = 10,
    max_rules: int = 6,
    max_conditions: int = 3,
    cuts: int = 20,
) -> list[list[Condition]]:
    """Sequential covering over ``labelled(bad 0/1, grow boolean, features)``.

    Each rule grows on the ``grow`` rows by the condition with the highest FOIL
    gain, thresholds being quantiles of the bad and of the good rows.  It is
    then pruned on the other rows: the shortest head whose precision there is
    best stays.  Rules under ``precision`` on the pruning rows, or covering
    fewer than ``least`` bad rows, end the search; rows a rule covers leave.
    Only counts come to the driver: at most names x cuts x 4 numbers a pass.
    """
    probs = [(i + 0.5) / cuts for i in range(cuts)]
    quantiles = labelled.groupBy("bad").agg(*[F.percentile_approx(n, probs, 1000).alias(n) for n in names]).collect()
    tests = []
    for n in names:
        values = sorted({float(v) for r in quantiles for v in (r[n] or [])})
        # between two neighbours, so that a threshold is not one row's own value
        tests += [Condition(n, above, (a + b) / 2) for a, b in zip(values, values[1:], strict=False) for above in (True, False)]
        tests += [Condition(n, True, v) for v in values[-1:]] + [Condition(n, False, v) for v in values[:1]]
    rules: list[list[Condition]] = []
    left = labelled
    while tests and len(rules) < max_rules:
        rule: list[Condition] = []
        rows = left.where("grow")
        p0, n0 = _counts(rows, [F.lit(True)])[0]
        while p0 and n0 and len(rule) < max_conditions:
            best, gain = None, 0.0
            for c, (p, n) in zip(tests, _counts(rows, [c.column() for c in tests]), strict=True):
                if p >= least:
                    g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if g > gain + 1e-9:
                        best, gain, after = c, g, (p, n)
            if best is None:
                break
            rule.append(best)
            rows, (p0, n0) = rows.where(best.column()), after
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        held = _counts(left.where("NOT grow"), [_and(h) for h in heads])
        share = [(p + 1) / (p + n + 2) for p, n in held]
        k = max(range(len(heads)), key=lambda i: (share[i], -i))
        p, n = held[k]
        if p < least / 2 or p < precision * (p + n):
            break
        rules.append(heads[k])
        left = left.where(~_and(heads[k]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that fires (from 1), else 0."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        out = F.when(_and(rules[i - 1]), F.lit(i)).otherwise(out)
    return out


def fit_rules(feats: DataFrame, labels: DataFrame, sample: int = 20000, id_col: str = "doc_id") -> list[list[Condition]]:
    """Learn from at most ``sample`` labelled rows, the ones with the smallest hash of their id.

    A row with a NULL id or label is not used; without labels, or with one
    class only, the list is empty and keeps everything.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    known = known.select(F.col(id_col), (F.col("quality") == 0).cast("int").alias("bad"))
    mix = F.xxhash64(F.lit("rows"), F.col(id_col))
    known = known.orderBy(mix, "bad").limit(sample).withColumn("grow", F.pmod(F.xxhash64(F.lit("grow"), F.col(id_col)), F.lit(3)) > 0)
    rows = feats.select(id_col, *FEATURES).join(known, id_col)
    return learn_list(cut(rows.select("bad", "grow", *FEATURES)))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    feats = cut(features(docs))
    rules = fit_rules(feats, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = feats.withColumn("base_failed", failed).withColumn("rule", F.when(failed, F.lit(0)).otherwise(verdict(rules)))
    return out.select("doc_id", *base, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
