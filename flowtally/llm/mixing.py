"""Mixing sources to target weights: temperature, then budgeted block permutations."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowtally.lineage import cut
from flowtally.llm.base import column, query, table, words_of

# levels of bisection that one pass over the source totals evaluates, and passes
LEVELS, PASSES = 4, 10
# a plan of so many rows at most (three numbers and a name each) is broadcast; a larger one is joined by shuffle
BROADCAST_ROWS = 10_000


def _sums(totals: DataFrame, exponents: list[float]) -> dict[int, tuple]:
    """For each exponent: sum of p^a, sum of p^a log p, largest and smallest p^(a - 1)."""
    x = F.pow("share", F.col("a"))
    per = F.pow("share", F.col("a") - 1)
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(exponents)]))
    rows = totals.where("share > 0").select("share", points.alias("p")).select("share", "p.i", "p.a")
    sums = rows.groupBy("i").agg(F.sum(x), F.sum(x * F.log("share")), F.max(per), F.min(per)).collect()
    return {r[0]: tuple(r)[1:] for r in sums}


def fit_exponent(totals: DataFrame, budget: float | None, entropy: float | None = None, max_repeat: float | None = None) -> tuple[float, float]:
    """``(exponent, budget)`` for weights p^a / sum p^a over ``totals(share, tokens)``.

    ``entropy`` (nats) is met by equality, the exponent being between 0
    (uniform) and 16; ``max_repeat`` bounds how often any source is repeated,
    and raises the exponent up to 1 if it must.  ``budget`` is the number of
    tokens to draw; None draws as many as it takes to use every source at least
    once in full.  Bisection runs on sums that Spark makes, several levels a
    pass, so any number of sources will do.
    """
    whole = totals.agg(F.sum("tokens"), F.count(F.when(F.col("share") > 0, 1))).first()
    total, n = float(whole[0] or 0), whole[1]
    if not n:
        return 1.0, 0.0

    def repeat(a, s):
        # most repeated source; without a budget the least repeated one is used once
        return s[2] / s[3] if budget is None else budget / total * s[2] / s[0]

    def bisect(low, high, too_low):
        """The exponent between a ``low`` that is too low and a ``high`` that is not."""
        for _ in range(PASSES):
            k = 1 << LEVELS
            points = [low + (high - low) * i / k for i in range(1, k)]
            sums = _sums(totals, points)
            below = [a for i, a in enumerate(points) if too_low(a, sums[i])]
            low, high = (below[-1] if below else low), next((a for a in points if not below or a > below[-1]), high)
        return high

    a = 1.0
    if entropy is not None:

        def spread(a, s):
            return math.log(s[0]) - a * s[1] / s[0] > entropy

        a = 0.0 if not spread(0.0, (n, 0.0)) else bisect(0.0, 16.0, spread)
    elif max_repeat is not None:
        a = 0.0
    if max_repeat is not None and a < 1:

        def often(a, s):
            return repeat(a, s) > max_repeat * (1 + 1e-12)

        if often(a, _sums(totals, [a])[0]):
            a = bisect(a, 1.0, often)
    if budget is None:
        s = _sums(totals, [a])[0]
        budget = total * s[0] / s[3]
    return a, budget


def allot(
    docs: DataFrame,
    tokens,
    budget: float | None = None,
    entropy_share: float | None = None,
    max_repeat: float | None = None,
    seed: int = 1,
    block_rows: int = 4096,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``_copies``, how often the target weights use each row (0 too), ``_mix_b``, its block, and ``_mix_key``, a hash.

    ``tokens`` is a column expression for a row's token count (NULL: 0).  A
    source that is due r times its tokens is used floor(r) times whole and then
    in part: its rows lie in blocks of about ``block_rows``, blocks are
    permuted and rows are permuted within their block, and rows are taken while
    the tokens before them are under what is left of the budget.  Block totals
    are summed first, so the running sum of a source of any size is a short
    window over blocks and one window inside each block.

    ``entropy_share`` is the target entropy as a share of log(number of
    sources).  NULL is a source of its own.  Rows of a source without any
    tokens are used once.  Repeated rows count each, and each has its own number
    of copies.  Rows without an id are placed by all their columns that can be
    hashed.  Columns of ``docs`` whose names begin with ``_mix_`` or equal
    ``_copies``, ``_epoch``, ``_block`` or ``_row`` are left out.
    """
    names = [c for c in docs.columns if not c.startswith("_mix_") and c not in ("_copies", "_epoch", "_block", "_row")]
    kept = [column(c) for c in names]
    hashable = [column(f.name) for f in docs.schema.fields if f.name in names and not re.search("map<|variant", f.dataType.simpleString())]
    key = F.when(column(id_col).isNull(), F.xxhash64(F.lit(seed), *hashable)).otherwise(F.xxhash64(F.lit(seed), column(id_col)))
    d = docs.select(*kept, F.coalesce(tokens.cast("long"), F.lit(0)).alias("_mix_tokens"), key.alias("_mix_key"))
    source = column(source_col)
    totals = d.groupBy(source.alias("src")).agg(F.sum("_mix_tokens").alias("tokens"), F.count("*").alias("rows"))
    totals = cut(totals)
    total = totals.agg(F.sum("tokens"), F.count(F.when(F.col("tokens") > 0, 1)), F.count("*"), F.sum("rows")).first()
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(total[0] or 1)))
    entropy = entropy_share * math.log(total[1]) if entropy_share is not None and total[1] else None
    a, budget = fit_exponent(shares, budget, entropy, max_repeat)
    norm = _sums(shares, [a]).get(0, (1.0,))[0]
    due = F.lit(budget / norm) * F.pow("share", F.lit(a)) / F.col("tokens")
    # one token in a million million off a whole number is rounding, not a part
    due = F.when(F.col("tokens") > 0, F.round(due, 12)).otherwise(F.lit(1.0))
    plan = shares.select(
        F.col("src").alias("_mix_src"),
        F.floor(due).alias("_mix_full"),
        (F.pmod(due, F.lit(1.0)) * F.col("tokens")).alias("_mix_part"),
        F.ceil(F.col("rows") / block_rows).alias("_mix_blocks"),
    )

    # a row finds its block without knowing the others: blocks are ranges of 31 bits of the row's hash
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("block"), F.col("_mix_key"), F.col("_mix_tokens")), 33)
    sources, rows = total[2], total[3] or 0
    plan = F.broadcast(plan) if sources <= BROADCAST_ROWS else plan
    planned = d.join(plan, source.eqNullSafe(F.col("_mix_src")))
    block = F.shiftright(place * F.col("_mix_blocks"), 31)
    # the source's own name for a group key that may be NULL
    planned = planned.withColumns({"_mix_b": block})
    blocks = planned.groupBy("_mix_src", "_mix_b", "_mix_full").agg(F.sum("_mix_tokens").alias("t"))
    order = W.partitionBy("_mix_src").orderBy(F.xxhash64(F.lit(seed), "_mix_full", "_mix_b"), "_mix_b")
    before = F.sum("t").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("t")
    blocks = blocks.select(F.col("_mix_src").alias("_mix_bs"), F.col("_mix_b").alias("_mix_bb"), before.alias("_mix_before"))
    blocks = F.broadcast(blocks) if rows / block_rows + sources <= BROADCAST_ROWS else blocks
    same = F.col("_mix_src").eqNullSafe(F.col("_mix_bs")) & (F.col("_mix_b") == F.col("_mix_bb"))
    joined = planned.join(blocks, same)
    inside = W.partitionBy("_mix_bs", "_mix_bb").orderBy(F.xxhash64(F.lit(seed), "_mix_full", "_mix_key", "_mix_tokens"), "_mix_key", "_mix_tokens")
    inside = F.sum("_mix_tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_mix_tokens")
    copies = F.col("_mix_full") + (F.col("_mix_before") + inside < F.col("_mix_part")).cast("int")
    return joined.select(*kept, copies.cast("int").alias("_copies"), "_mix_b", F.xxhash64("_mix_key", "_mix_tokens").alias("_mix_key"))


def mix(docs: DataFrame, tokens, budget: float | None = None, seed: int = 1, **targets) -> DataFrame:
    """``docs`` drawn to the target weights: a row per copy, with ``_epoch``, ``_block`` and ``_row``.

    Copies and arguments are those of ``allot``.  Sorting by
    ``(_epoch, _block, _row)`` gives the order of the mixture.
    """
    given = allot(docs, tokens, budget, seed=seed, **targets)
    kept = [column(c) for c in given.columns if c not in ("_copies", "_mix_b", "_mix_key")]
    epochs = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))
    drawn = given.where("_copies > 0").select(*kept, "_mix_b", "_mix_key", epochs.alias("_epoch"))
    block, row = (F.xxhash64(F.lit(seed), "_epoch", c) for c in ("_mix_b", "_mix_key"))
    return drawn.select(*kept, "_epoch", block.alias("_block"), row.alias("_row"))


@query("op8_mix_sources")
def op8_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))
    sized = cut(sized)
    budget = float(sized.agg(F.sum("n_tokens")).first()[0] or 0)
    given = allot(sized, F.col("n_tokens"), budget, entropy_share=0.97, max_repeat=4.0)
    return given.select("doc_id", "source", "n_tokens", F.col("_copies").cast("long").alias("copies"))
