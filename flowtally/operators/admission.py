"""Budget admission of requests in arrival order.

Per tenant and month a request is blocked if the budget is used up or the
request would exceed it; only admitted requests add to the spend, and a repeat
of an entry replaces its earlier estimate.  So this is no running sum.

It still is one up to the first block: before it everything was admitted.
That head is computed with ordinary running sums, hot tenants in chunks.
After the first block most requests are too large for whatever can be left of
the budget, however the others turn out; those are blocked without order.
What remains is the same question again, with what is left of the budget: for
a hot tenant it goes through further rounds, and when no tenant and month is
hot any more it is folded in order.  Amounts are whole millionths of a dollar, so
sums do not depend on how rows are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.lineage import cut
from flowtally.operators.aggregates import BUDGET_WARN_RATIO
from flowtally.operators.lookups import with_budget
from flowtally.skew import MIN_ROWS, NEVER, PARTS, hot_keys, with_previous, with_running

_GROUP = ["tenant", "month"]
MICROS = 1_000_000
# rounds for hot tenants; what is open after the last one is folded whatever its size
ROUNDS = 4


def _micros(name: str):
    return F.round(F.col(name).cast("double") * MICROS).cast("bigint")


def _decision(spent: int, cost: int, limit: int, warn: float) -> str:
    if spent >= limit or spent + cost > limit:
        return "BLOCK"
    return "WARN" if limit > 0 and (spent + cost) / limit >= warn else "ALLOW"


def _fold(warn: float):
    """Decide requests sorted by tenant, month and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, spent, changed = None, 0, {}
        for batch in batches:
            cols = [
                batch.column(n).to_pylist()
                for n in ("tenant", "month", "entry_id", "__cost", "__writes", "__limit", "__base", "__own")
            ]
            out = []
            for tenant, month, entry, cost, writes, limit, base, own in zip(*cols, strict=True):
                if group != (tenant, month):
                    group, spent, changed = (tenant, month), base, {}
                decision = _decision(spent, cost, limit, warn)
                out.append(decision)
                if writes and decision != "BLOCK":
                    spent += cost - changed.get(entry, own or 0)
                    changed[entry] = cost
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, type=pa.string())], names=[*batch.schema.names, "decision"]
            )

    return run


def budget_admission(
    requests: DataFrame,
    budgets: DataFrame,
    ledger: DataFrame | None = None,
    order: str = "seq",
    blocked: str | None = None,
    default_limit: float | None = None,
    warn_ratio: float = BUDGET_WARN_RATIO,
    *,
    rounds: int = ROUNDS,
    min_rows: int = MIN_ROWS,
    parts: int = PARTS,
) -> DataFrame:
    """Add ``decision`` to requests (tenant, month, entry_id, estimated_cost_usd, ``order``).

    ``ledger`` (tenant, month, entry_id, estimated_cost_usd) holds what was
    admitted before, one row per entry.  ``blocked`` names a boolean column of
    requests that other checks refuse; they do not spend.  A request without
    an estimate is judged with 0 and writes no entry.
    """
    columns = requests.columns
    zero = F.lit(0).cast("bigint")
    refused = F.coalesce(F.col(blocked), F.lit(False)) if blocked else F.lit(False)
    base = with_budget(requests.drop("limit_usd"), budgets, default_limit)
    if ledger is None:
        base = base.withColumns({"__base": zero, "__own": F.lit(None).cast("bigint")})
    else:
        # the past is a sum per tenant and month, and one estimate per entry
        past = ledger.select(*_GROUP, "entry_id", _micros("estimated_cost_usd").alias("__own"))
        base = base.join(past.groupBy(*_GROUP).agg(F.sum("__own").alias("__base")), _GROUP, "left")
        base = base.join(past, [*_GROUP, "entry_id"], "left").fillna({"__base": 0})
    rows = base.withColumns(
        {
            "__refused": refused,
            "__cost": F.coalesce(_micros("estimated_cost_usd"), zero),
            "__writes": F.col("estimated_cost_usd").isNotNull(),
            "__limit": _micros("limit_usd"),
        }
    )
    closed = rows.where(F.col("__refused")).withColumn("decision", F.lit("BLOCK"))
    parts_out = [closed]
    carried_columns = [*columns, "__cost", "__writes", "__limit", "__base", "__own"]
    current = rows.where(~F.col("__refused")).select(*carried_columns)
    for turn in range(max(1, rounds)):
        # no entry can hold more rows than its tenant and month, so one count does for both
        calm = hot_keys(current, _GROUP, order, min_rows=min_rows, parts=parts) is None
        head, lost, unsure = _round(current, order, warn_ratio, NEVER if calm else min_rows)
        parts_out += [head, lost]
        if calm or turn >= rounds - 1:
            break
        current = cut(unsure.select(*carried_columns))
    ready = unsure.repartition(*_GROUP).sortWithinPartitions(*_GROUP, order)
    parts_out.append(ready.mapInArrow(_fold(float(warn_ratio)), ready.withColumn("decision", F.lit("")).schema))
    out = None
    for part in parts_out:
        one = part.select(*columns, "decision")
        out = one if out is None else out.unionByName(one)
    return out


def _round(
    rows: DataFrame, order: str, warn_ratio: float, min_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split open requests into admitted ones, hopeless ones and the rest.

    The rest comes with ``__base`` and ``__own`` as they are after the admitted
    ones: spend of its tenant and month, and estimate of its entry.
    """
    zero = F.lit(0).cast("bigint")
    split = dict(chunk_rows=min_rows)
    known = with_previous(rows, [*_GROUP, "entry_id", "__writes"], [order], {"__prev": "__cost"}, **split)
    delta = F.when(F.col("__writes"), F.col("__cost") - F.coalesce("__prev", "__own", zero)).otherwise(zero)
    summed = with_running(known.withColumn("__d", delta), _GROUP, [order], {"__after": "__d"}, **split)
    summed = summed.withColumn("__before", F.col("__base") + F.col("__after") - F.col("__d"))
    over = (F.col("__before") >= F.col("__limit")) | (F.col("__before") + F.col("__cost") > F.col("__limit"))
    # read by every step below, so it is computed once
    summed = cut(summed.withColumn("__over", over))

    first = (
        summed.where("__over")
        .groupBy(*_GROUP)
        .agg(F.min(order).alias("__first"), F.min_by("__before", order).alias("__spent"))
    )
    marked = summed.join(first, _GROUP, "left")
    late = F.col("__first").isNotNull()
    in_tail = F.col(order) >= F.col("__first")
    near = (F.col("__limit") > 0) & (F.try_divide(F.col("__before") + F.col("__cost"), F.col("__limit")) >= warn_ratio)
    head = marked.where(~late | ~in_tail).withColumn("decision", F.when(near, "WARN").otherwise("ALLOW"))

    writes = F.col("__writes")
    last_head = F.max_by("__cost", F.when(writes & ~in_tail, F.col(order)))
    entries = (
        marked.where(late)
        .groupBy(*_GROUP, "entry_id")
        .agg(
            F.coalesce(last_head, F.max("__own")).alias("__carried"),
            F.coalesce(F.max("__own"), zero).alias("__was"),
            F.max("__base").alias("__base"),
            F.min(F.when(writes & in_tail, F.col("__cost"))).alias("__least"),
        )
    )
    # the spend can never fall below this: entries stay, and only a repeat can lower one
    lowest = F.coalesce(F.least("__carried", "__least"), zero)
    fresh = F.least(zero, F.coalesce("__least", zero))
    floor = entries.groupBy(*_GROUP).agg(
        (
            F.max("__base")
            + F.sum(F.when(F.col("__carried").isNotNull(), lowest - F.col("__was")).otherwise(fresh))
        ).alias("__floor")
    )
    tail = marked.where(late & in_tail).join(floor, _GROUP, "left")
    hopeless = (F.col("__floor") >= F.col("__limit")) | (F.col("__floor") + F.col("__cost") > F.col("__limit"))
    tail = tail.withColumn("__hopeless", F.coalesce(hopeless, F.lit(False)))
    lost = tail.where("__hopeless").withColumn("decision", F.lit("BLOCK"))
    unsure = (
        tail.where(~F.col("__hopeless"))
        .drop("__base", "__own")
        .join(entries.select(*_GROUP, "entry_id", F.col("__carried").alias("__own")), [*_GROUP, "entry_id"], "left")
        .withColumnRenamed("__spent", "__base")
    )
    return head, lost, unsure.select(*rows.columns)


def admitted_entries(decisions: DataFrame, order: str = "seq") -> DataFrame:
    """Ledger entries the decisions leave: the last admitted estimate of each entry."""
    kept = decisions.where(F.col("decision").isin("ALLOW", "WARN") & F.col("estimated_cost_usd").isNotNull())
    return kept.groupBy(*_GROUP, "entry_id").agg(F.max_by("estimated_cost_usd", order).alias("estimated_cost_usd"))
