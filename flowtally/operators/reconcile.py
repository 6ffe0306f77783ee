"""Comparison of snapshots, manifests and schemas.

Sides are tagged, unioned and grouped by key instead of joined: each task
first reduces its own rows, so repeated keys cost nothing in the shuffle, and
only key and hash travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from flowtally.functions.hashing import change_hash
from flowtally.functions.scalars import SPACE, scope_for_path, strip

MANIFEST_NAME = "packaging_manifest.json"


def _stack(sides: Mapping[str, DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key with ``<side>_<value>`` columns and an ``in_<side>`` flag.

    Rows of a key are compared as a multiset.  Rows that agree give their value.
    Where strings of one side differ, the value is a hash of all of them (their
    number, the sum of their hashes, the smallest and the largest), so a
    repeated key can't hide a change and no rows are gathered; other types keep
    the largest value.
    """
    tagged = [
        df.select(*keys, *values, F.lit(name).alias("__side"))
        for name, df in sides.items()
    ]
    both = reduce(DataFrame.unionByName, tagged)
    texts = {v for v in values if isinstance(both.schema[v].dataType, StringType)}
    aggs, out = [], list(keys)
    for name in sides:
        on = F.col("__side") == name
        aggs.append(F.coalesce(F.bool_or(on), F.lit(False)).alias(f"in_{name}"))
        aggs.append(F.count_if(on).alias(f"__{name}_n"))
        out.append(f"in_{name}")
        for v in values:
            own, mark = F.when(on, F.col(v)), f"__{name}_{v}"
            aggs.append(F.max(own).alias(f"{mark}_hi"))
            if v not in texts:
                out.append(F.col(f"{mark}_hi").alias(f"{name}_{v}"))
                continue
            aggs += [
                F.min(own).alias(f"{mark}_lo"),
                F.count(own).alias(f"{mark}_k"),
                F.sum(F.when(on, F.xxhash64(v)).cast("decimal(38,0)")).alias(f"{mark}_s"),
            ]
            lo, hi, k, n = F.col(f"{mark}_lo"), F.col(f"{mark}_hi"), F.col(f"{mark}_k"), F.col(f"__{name}_n")
            agree = (lo == hi) & (k == n) | (k == 0)
            several = F.sha2(F.concat_ws("|", n, F.col(f"{mark}_s"), lo, hi).cast("binary"), 256)
            out.append(F.when(agree, lo).otherwise(several).alias(f"{name}_{v}"))
    return both.groupBy(*keys).agg(*aggs).select(*out)


def snapshot_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Keys that were ``added``, ``removed`` or ``changed`` from ``a`` to ``b``, with both hashes.

    Rows are compared by a hash of ``columns`` (default: all but the keys);
    a single column named ``sha256`` is compared as it is.
    """
    names = list(columns) if columns is not None else [c for c in a.columns if c not in keys]
    ready = names == ["sha256"]

    def hashed(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.col("sha256") if ready else change_hash(names).alias("sha256"))

    pairs = _stack({"a": hashed(a), "b": hashed(b)}, keys, ["sha256"])
    status = (
        F.when(~F.col("in_a"), "added")
        .when(~F.col("in_b"), "removed")
        .when(~F.col("a_sha256").eqNullSafe(F.col("b_sha256")), "changed")
    )
    return (
        pairs.withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(*keys, "status", F.col("a_sha256").alias("sha256_a"), F.col("b_sha256").alias("sha256_b"))
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: added, removed, changed."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed")])


def three_way_reconcile(
    base: DataFrame,
    upstream: DataFrame,
    workspace: DataFrame,
    key: str = "path",
    hash_col: str = "sha256",
    mode: str = "linear",
    scopes: Sequence[str] = ("jobs", "dags", "configs"),
) -> DataFrame:
    """Paths where upstream and workspace differ, and whether they can be applied without review.

    ``mode`` is ``linear``, ``diverged`` or ``unrelated_histories``; the last
    two send every path to review.  A missing side has a NULL hash, and NULL
    equals NULL.
    """
    if mode not in ("linear", "diverged", "unrelated_histories"):
        raise ValueError(f"unknown mode {mode!r}")
    sides = {"baseline": base, "upstream": upstream, "workspace": workspace}
    all3 = _stack(sides, [key], [hash_col])
    h_base, h_up, h_ws = (F.col(f"{s}_{hash_col}") for s in sides)
    items = all3.where(~h_up.eqNullSafe(h_ws))
    clean = h_ws.eqNullSafe(h_base) & ~h_up.eqNullSafe(h_base)
    if mode == "linear":
        apply_mode = F.when(clean, "safe_auto").otherwise("manual")
        reason = F.when(clean, "workspace_clean_upstream_changed").otherwise("requires_manual_review")
    else:
        apply_mode, reason = F.lit("manual"), F.lit(mode)
    # the change seen from upstream to workspace
    status = F.when(h_up.isNull(), "A").when(h_ws.isNull(), "D").otherwise("M")
    return items.select(
        key,
        scope_for_path(key, scopes).alias("scope"),
        status.alias("status"),
        h_base.alias("baseline"),
        h_up.alias("upstream"),
        h_ws.alias("workspace"),
        apply_mode.alias("apply_mode"),
        reason.alias("reason"),
    )


def sync_summary(items: DataFrame) -> DataFrame:
    """One row: total, safe_auto and manual items."""
    auto = F.col("apply_mode") == "safe_auto"
    # a global aggregate: one row, also without items
    return items.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(auto).alias("safe_auto_items"),
        F.count_if(~F.coalesce(auto, F.lit(False))).alias("manual_items"),
    )


# What to do with a sync, by how the two histories lie to each other
SYNC_ACTIONS = {
    "unrelated_histories": "reset_or_rebaseline_required",
    "diverged": "manual_resolution_required",
    "workspace_behind_linear": "safe_auto_apply_possible",
    "workspace_ahead_linear": "workspace_ahead_review_then_apply",
}
OTHER_ACTION = "manual_review"


def recommended_action(topology: Column | str) -> Column:
    """The action a topology asks for; any other one, NULL included, asks for a review."""
    t = F.col(topology) if isinstance(topology, str) else topology
    out = F.lit(OTHER_ACTION)
    for name, action in SYNC_ACTIONS.items():
        out = F.when(t == name, action).otherwise(out)
    return out


def sync_summaries(items: DataFrame, syncs: DataFrame, key: str = "sync") -> DataFrame:
    """One row per sync of ``syncs(key, topology)``: its item counts and ``recommended_action``.

    Counts are made per key before the join, so a sync with most of the items
    is one row per task.  Syncs without items have zeros; items of no known
    sync are left out; repeated syncs stay.
    """
    auto = F.col("apply_mode") == "safe_auto"
    counts = items.groupBy(F.col(key).alias("__key")).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(auto).alias("safe_auto_items"),
        F.count_if(~F.coalesce(auto, F.lit(False))).alias("manual_items"),
    )
    names = ("total_items", "safe_auto_items", "manual_items")
    out = syncs.select(key, "topology").join(counts, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.select(
        key, "topology", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], recommended_action("topology").alias("recommended_action")
    )


def manifest_equal(
    a: DataFrame,
    b: DataFrame,
    header_a: Mapping[str, object] | None = None,
    header_b: Mapping[str, object] | None = None,
) -> DataFrame:
    """One row ``equal``: same headers, paths and hashes; sizes count only where both are known.

    The manifest's own file is left out.
    """
    fields = ("kind", "include_paths", "excludes")
    one, two = header_a or {}, header_b or {}
    same_header = all(one.get(f) == two.get(f) for f in fields)

    def files(df: DataFrame) -> DataFrame:
        own = F.replace(F.col("path"), F.lit("\\"), F.lit("/")) == MANIFEST_NAME
        return df.where((F.length("path") > 0) & ~own)

    pairs = _stack({"a": files(a), "b": files(b)}, ["path"], ["sha256", "size"])
    size_ok = F.coalesce(F.col("a_size") == F.col("b_size"), F.lit(True))
    ok = F.col("in_a") & F.col("in_b") & F.col("a_sha256").eqNullSafe(F.col("b_sha256")) & size_ok
    return pairs.agg((F.coalesce(F.bool_and(ok), F.lit(True)) & F.lit(same_header)).alias("equal"))


def verify_hashes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status, sha256_ok, expected_sha256, actual_sha256).

    ``status`` is ``missing``, ``extra``, ``mismatched``, ``ok``, or
    ``unchecked`` where no hash was declared.
    """
    pairs = _stack({"expected": expected, "actual": actual}, ["path"], ["sha256"])
    declared = F.length("expected_sha256") > 0
    same = F.col("expected_sha256").eqNullSafe(F.col("actual_sha256"))
    status = (
        F.when(~F.col("in_actual"), "missing")
        .when(~F.col("in_expected"), "extra")
        .when(~F.coalesce(declared, F.lit(False)), "unchecked")
        .when(same, "ok")
        .otherwise("mismatched")
    )
    out = pairs.withColumn("status", status)
    return out.select(
        "path",
        "status",
        F.when(F.col("status").isin("ok", "mismatched"), F.col("status") == "ok").alias("sha256_ok"),
        "expected_sha256",
        "actual_sha256",
    )


def verify_summary(checks: DataFrame, strict_no_extras: bool = False) -> DataFrame:
    """One row: missing, extras, mismatched, and ``ok``."""
    counts = checks.agg(
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "extra").alias("extras"),
        F.count_if(F.col("status") == "mismatched").alias("mismatched"),
    )
    ok = (F.col("missing") == 0) & (F.col("mismatched") == 0)
    if strict_no_extras:
        ok = ok & (F.col("extras") == 0)
    return counts.withColumn("ok", ok)


def verify_releases(checks: DataFrame, releases: DataFrame, key: str = "release", strict_no_extras: bool = False) -> DataFrame:
    """One row per release: file counts, ``sha256_match`` of its archive, ``manifest_ok`` and ``ok``.

    ``checks`` are rows of ``verify_hashes`` with the release they belong to,
    ``releases`` are ``(key, expected_sha256, actual_sha256)`` of the archives.
    Without an expected hash the archive matches; without an archive it does
    not.  Without the packaging manifest nothing can be checked file by file:
    a release with no check rows has a manifest that is not ok.
    """
    statuses = {"missing": "missing", "extras": "extra", "mismatched": "mismatched"}
    counts = checks.groupBy(F.col(key).alias("__key")).agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in statuses.items()])
    out = releases.join(counts, F.col(key).eqNullSafe(F.col("__key")), "left")
    known = F.col("missing").isNotNull()
    clean = known & (F.col("missing") == 0) & (F.col("mismatched") == 0)
    if strict_no_extras:
        clean = clean & (F.col("extras") == 0)
    there = F.col("actual_sha256").isNotNull()
    match = there & (F.col("expected_sha256").isNull() | (F.col("expected_sha256") == F.col("actual_sha256")))
    match, clean = (F.coalesce(c, F.lit(False)) for c in (match, clean))
    return out.select(
        key,
        *[F.coalesce(n, F.lit(0)).alias(n) for n in statuses],
        match.alias("sha256_match"),
        clean.alias("manifest_ok"),
        (match & clean).alias("ok"),
    )


def artifact_integrity(expected: DataFrame, artifacts: DataFrame, sums: DataFrame) -> DataFrame:
    """Check each expected ``path`` against ``artifacts(path, sha256)`` and ``sums(path, line)``.

    The expected hash is the first word of the sum line.
    """
    joined = expected.select("path").join(
        artifacts.select("path", F.col("sha256").alias("actual_sha")), "path", "left"
    ).join(sums.select("path", F.split(strip("line"), f"[{SPACE}]+")[0].alias("expected_sha")), "path", "left")
    reason = F.when(F.col("actual_sha").isNull(), "artifact_missing").when(
        F.col("expected_sha").isNull(), "sha_file_missing"
    )
    out = joined.withColumn("reason", reason)
    valid = F.col("reason").isNull() & (F.col("actual_sha") == F.col("expected_sha"))
    both = F.col("reason").isNull()
    return out.select(
        "path",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        "reason",
        F.when(both, F.col("expected_sha")).alias("expected_sha"),
        F.when(both, F.col("actual_sha")).alias("actual_sha"),
    )


def schema_diff(current: DataFrame, new: DataFrame) -> DataFrame:
    """Column changes of many tables at once.

    Both sides are catalogs (table_name, column_name, data_type).  One row per
    differing column: ``change`` is ``added``, ``changed`` or ``removed``.
    """
    keys = ["table_name", "column_name"]
    pairs = _stack({"cur": current, "new": new}, keys, ["data_type"])
    change: Column = (
        F.when(~F.col("in_cur"), "added")
        .when(~F.col("in_new"), "removed")
        .when(~F.col("cur_data_type").eqNullSafe(F.col("new_data_type")), "changed")
    )
    return pairs.withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, "change")


def schema_diff_summary(diff: DataFrame) -> DataFrame:
    """Per table: number of added, changed and removed columns, and ``breaking_change``."""
    return diff.groupBy("table_name").agg(
        F.count_if(F.col("change") == "added").alias("added_columns"),
        F.count_if(F.col("change") == "changed").alias("changed_columns"),
        F.count_if(F.col("change") == "removed").alias("removed_columns"),
        F.bool_or(F.col("change") == "changed").alias("breaking_change"),
    )
