"""Joins of records to budgets, prices, approvals and lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.scalars import filled, parse_iso_utc

# Fixed values
DEFAULT_LIMIT_USD = 250.0
FALLBACK_PRICE = 0.05
VCPU_HOUR_USD = {
    ("aws", "us-east-1"): 0.045,
    ("aws", "eu-west-1"): 0.052,
    ("gcp", "us-central1"): 0.044,
    ("gcp", "europe-west1"): 0.050,
    ("azure", "eastus"): 0.047,
    ("azure", "westeurope"): 0.053,
    ("k8s", "default"): 0.040,
}
HIGH_AREAS = ("policy", "cache")
MEDIUM_AREAS = ("api", "sync", "repo")
APPROVAL_TTL_SECONDS = 3600.0


def with_budget(df: DataFrame, budgets: DataFrame, default: float | None = None) -> DataFrame:
    """Add ``limit_usd``: the tenant's limit if set, else ``default``, else 250.

    Spark broadcasts the budgets when they are small and shuffles otherwise.
    """
    limits = budgets.groupBy("tenant").agg(F.max("limit_usd").alias("__limit"))
    fallback = float(DEFAULT_LIMIT_USD if default is None else default)
    return (
        df.join(limits, "tenant", "left")
        .withColumn("limit_usd", F.coalesce(F.col("__limit").cast("double"), F.lit(fallback)))
        .drop("__limit")
    )


def with_price(
    df: DataFrame,
    overrides: DataFrame | None = None,
    provider: str = "provider",
    region: str = "region",
) -> DataFrame:
    """Add ``region_used`` and ``vcpu_hour_usd``.

    Looked up by (provider, region), then (provider, ``default``), then the
    fallback price; an override of a key wins over the built-in price.
    """
    name = F.lower(provider)
    place = F.coalesce(filled(region), F.when(name == "k8s", "default").otherwise("us-east-1"))
    out = df.withColumns({"__p": name, "region_used": place})

    def built_in(where: Column) -> Column:
        price = F.lit(None).cast("double")
        for (p, r), usd in VCPU_HOUR_USD.items():
            price = F.when((F.col("__p") == p) & (where == r), F.lit(usd)).otherwise(price)
        return price

    exact, default = built_in(F.col("region_used")), built_in(F.lit("default"))
    if overrides is not None:
        own = overrides.groupBy("provider", "region").agg(F.max("price").alias("__own"))
        own = own.select(F.col("provider").alias("__op"), F.col("region").alias("__or"), "__own")
        by_key = (F.col("__p") == F.col("__op")) & (F.col("region_used") == F.col("__or"))
        out = out.join(own, by_key, "left").drop("__op", "__or").withColumnRenamed("__own", "__own_exact")
        any_region = own.where(F.col("__or") == "default").drop("__or")
        out = out.join(any_region, F.col("__p") == F.col("__op"), "left").drop("__op")
        exact = F.coalesce(F.col("__own_exact"), exact)
        default = F.coalesce(F.col("__own"), default)
    price = F.coalesce(exact, default, F.lit(FALLBACK_PRICE))
    return out.withColumn("vcpu_hour_usd", price).drop("__p", "__own", "__own_exact")


def valid_approval(
    requests: DataFrame,
    approvals: DataFrame,
    as_of: Column | str,
    ttl_seconds: float = APPROVAL_TTL_SECONDS,
    order: str = "approved_at",
) -> DataFrame:
    """Add ``approved``, ``approver`` and ``approved_at`` to requests (job_name, plan_hash).

    The last approval of a pair by ``order`` counts.  It is valid up to
    ``ttl_seconds``; an approval time that cannot be parsed stays valid.
    ``approved_at`` of the approvals is ISO text.
    """
    keys = ["job_name", "plan_hash"]
    last = approvals.groupBy(*keys).agg(
        F.max_by(F.struct("approver", "approved_at"), F.struct(order, "approver")).alias("__a")
    )
    at = F.col(as_of) if isinstance(as_of, str) else as_of
    given = parse_iso_utc(F.col("__a.approved_at"))
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(given)) / F.lit(1e6)
    fresh = F.col("__a").isNotNull() & F.coalesce(age <= F.lit(float(ttl_seconds)), F.lit(True))
    return (
        requests.join(last, keys, "left")
        .withColumns(
            {
                "approved": fresh,
                "approver": F.when(fresh, F.col("__a.approver")),
                "approved_at": F.when(fresh, F.col("__a.approved_at")),
            }
        )
        .drop("__a")
    )


def lineage_check(
    builds: DataFrame,
    contracts: DataFrame,
    plans: DataFrame,
    reports: DataFrame,
    evaluations: DataFrame,
) -> DataFrame:
    """Add ``failure``: the first reason why a build may not run, or NULL.

    Builds carry job_name and the four hashes; the other tables carry job_name
    and their hash, evaluations also the three hashes they were made for and a
    decision.
    """
    out = builds
    for table, column, flag in (
        (contracts, "contract_hash", "__c"),
        (plans, "plan_hash", "__p"),
        (reports, "intelligence_hash", "__r"),
    ):
        known = table.select("job_name", column).distinct().withColumn(flag, F.lit(True))
        out = out.join(known, ["job_name", column], "left")
    checked = evaluations.select(
        "job_name",
        "policy_eval_hash",
        F.struct("contract_hash", "plan_hash", "intelligence_hash", "decision").alias("__e"),
    ).groupBy("job_name", "policy_eval_hash").agg(F.min("__e").alias("__e"))
    out = out.join(checked, ["job_name", "policy_eval_hash"], "left")

    def linked(name: str) -> Column:
        return F.col(f"__e.{name}").eqNullSafe(F.col(name))

    failure = (
        F.when(F.col("__c").isNull(), "Invalid contract hash")
        .when(F.col("__p").isNull(), "Invalid plan hash")
        .when(F.col("__r").isNull(), "Invalid intelligence hash")
        .when(F.col("__e").isNull(), "Invalid policy evaluation hash")
        .when(~linked("contract_hash"), "Policy evaluation does not match contract hash")
        .when(~linked("plan_hash"), "Policy evaluation does not match plan hash")
        .when(~linked("intelligence_hash"), "Policy evaluation does not match intelligence hash")
        .when(F.col("__e.decision") == "BLOCK", "Build blocked by policy")
    )
    return out.withColumn("failure", failure).select(*builds.columns, "failure")


def classify_paths(df: DataFrame, rules: Mapping[str, Sequence[str]], path: str = "path") -> DataFrame:
    """One row per path and area whose patterns occur in the path.

    The rules become one expression, so nothing is joined.  Files of an area
    stay rows; a list per area could grow without limit.
    """
    areas = []
    for area, patterns in rules.items():
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | F.col(path).contains(pattern)
        if area in HIGH_AREAS:
            severity, why = "high", f"{area} changes can alter deterministic execution"
        elif area in MEDIUM_AREAS:
            severity, why = "medium", f"{area} changes can affect external API contract/behavior"
        else:
            severity, why = "low", f"{area} changes are typically localized"
        packed = F.struct(F.lit(area).alias("area"), F.lit(severity).alias("severity"), F.lit(why).alias("reason"))
        areas.append(F.when(hit, packed))
    hits = F.array_compact(F.array(*areas))
    return df.withColumn("__a", F.explode(hits)).select(*df.columns, "__a.*")


def impact_summary(classified: DataFrame) -> DataFrame:
    """Files per area."""
    return classified.groupBy("area", "severity", "reason").agg(F.count(F.lit(1)).alias("files"))
