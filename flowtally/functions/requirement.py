"""Requirement text to job specification columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.scalars import SPACE, safe_identifier, strip

# Patterns per field, tried in order
PATTERNS: Mapping[str, Sequence[str]] = {
    "job_name": (
        r"\bjob\s*name\s*[:=]\s*([A-Za-z0-9_\-]+)\b",
        r"\bpipeline\s*[:=]\s*([A-Za-z0-9_\-]+)\b",
    ),
    "env": (r"\benv(?:ironment)?\s*[:=]\s*(dev|qa|prod)\b",),
    "timezone": (r"\btimezone\s*[:=]\s*([A-Za-z_\/]+)\b",),
    "schedule": (
        r"\bschedule\s*[:=]\s*([0-9\*\/,\-\s]+)\b",
        r"\bcron\s*[:=]\s*([0-9\*\/,\-\s]+)\b",
    ),
    "owner": (r"\bowner\s*[:=]\s*([A-Za-z0-9_\-\.@]+)\b",),
    "language": (r"\blanguage\s*[:=]\s*(pyspark|scala)\b", r"\b(pyspark|scala)\b"),
    "source_table": (
        r"\bsource\s*table\s*[:=]\s*([A-Za-z0-9_]+\.[A-Za-z0-9_]+)\b",
        r"\bread\s+from\s+([A-Za-z0-9_]+\.[A-Za-z0-9_]+)\b",
    ),
    "target_table": (
        r"\btarget\s*table\s*[:=]\s*([A-Za-z0-9_]+\.[A-Za-z0-9_]+)\b",
        r"\bwrite\s+to\s+([A-Za-z0-9_]+\.[A-Za-z0-9_]+)\b",
    ),
    "partition_column": (
        r"\bpartition_column\s*[:=]\s*([A-Za-z0-9_]+)\b",
        r"\bpartition(?:ed)?\s*(?:by)?\s*[:=]?\s*([A-Za-z0-9_]+)\b",
    ),
    "write_mode": (
        r"\bwrite\s*mode\s*[:=]\s*(merge|append|overwrite)\b",
        r"\b(merge|append|overwrite)\b",
    ),
}
DEFAULTS: Mapping[str, str] = {
    "env": "dev",
    "timezone": "UTC",
    "schedule": "0 6 * * *",
    "owner": "data-platform",
    "language": "pyspark",
    "source_table": "raw_db.source_table",
    "target_table": "curated_db.target_table",
    "partition_column": "data_dt",
    "write_mode": "merge",
}
CHOICES: Mapping[str, Sequence[str]] = {
    "env": ("dev", "qa", "prod"),
    "language": ("pyspark", "scala"),
    "write_mode": ("merge", "append", "overwrite"),
}
DESCRIPTION = "Generated from requirement"
# Fields whose absence from the text is worth a warning
WARN_MISSING = ("env", "schedule", "source_table", "target_table")


def _openings(pattern: str) -> list[str]:
    """The lower-case words one of which every match of ``pattern`` begins with."""
    opening = re.match(r"\\b(?:([a-z_]+)|\(([a-z|]+)\))", pattern)
    return [opening[1]] if opening[1] else opening[2].split("|")


def _capture(name: str, at: int) -> Column:
    """Group 1 of one pattern, or "" where it does not match.

    A pattern is tried only on a text that holds a word it begins with, and
    only if the field's patterns before it found nothing.
    """
    pattern = PATTERNS[name][at]
    may = reduce(or_, [F.contains(F.col("__lower"), F.lit(word)) for word in _openings(pattern)])
    for earlier in range(at):
        may = may & (F.col(f"__{name}_{earlier}") == "")
    return F.when(may, F.regexp_extract("__text", "(?i)" + pattern, 1)).otherwise("")


def _with_captures(df: DataFrame) -> DataFrame:
    """Every capture in a column of its own, so that it is computed once; a field's later patterns see its earlier ones."""
    for at in range(max(len(p) for p in PATTERNS.values())):
        df = df.withColumns({f"__{name}_{at}": _capture(name, at) for name in PATTERNS if at < len(PATTERNS[name])})
    return df


def _found(name: str) -> Column:
    """Capture of the first pattern of a field that matches, trimmed; NULL if none or blank.

    Group 1 holds at least one character in every pattern, so an empty capture
    means that the pattern does not match.
    """
    tries = [F.col(f"__{name}_{i}") for i in range(len(PATTERNS[name]))]
    return F.nullif(F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in tries])), F.lit(""))


def extract_spec(
    df: DataFrame,
    text_col: str,
    hint_col: str | None = None,
    defaults: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Add one column per specification field, ``description``, ``tags``, ``warnings`` (codes) and ``confidence``.

    The text never names description and tags: they come from ``defaults``,
    tags as a list or as text parted by commas.  Without them the description
    is a fixed one and the only tag is the row's ``env``.

    ``defaults`` replaces the built-in default of a field and silences its
    "missing" warning.
    """
    given = dict(defaults or {})
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"[{SPACE}]+", " "))
    captures = [f"__{name}_{at}" for name, patterns in PATTERNS.items() for at in range(len(patterns))]
    raws = {f"__raw_{name}": _found(name) for name in PATTERNS}
    out = _with_captures(df.withColumn("__text", clean).withColumn("__lower", F.lower("__text"))).withColumns(raws)

    fields: dict[str, Column] = {}
    warnings: list[Column] = []

    def warn(when: Column | bool, code: str) -> None:
        if isinstance(when, bool):
            when = F.lit(when)
        warnings.append(F.when(when, F.lit(code)))

    preset = given.get("preset") or "generic"
    if preset not in ("generic", "enterprise_a", "enterprise_b"):
        warn(True, "preset.invalid")
        preset = "generic"
    fields["preset"] = F.lit(preset)

    hint = F.nullif(F.col(hint_col), F.lit("")) if hint_col else F.lit(None).cast("string")
    raw_job = F.coalesce(
        F.col("__raw_job_name"), hint, F.lit(str(given["job_name"]) if given.get("job_name") else None).cast("string")
    )
    out = out.withColumns({"__job": raw_job, "job_name": safe_identifier(raw_job, "job")})
    warn(F.col("__job").isNull(), "job_name.missing")
    warn(F.col("__job").isNotNull() & (F.col("job_name") != strip("__job")), "job_name.sanitized")

    for name, fallback in DEFAULTS.items():
        raw = F.col(f"__raw_{name}")
        value = str(given.get(name) or fallback).strip() or fallback
        if name in CHOICES:
            value = value.lower()
            if value not in CHOICES[name]:
                # a bad default only matters where the text names no value
                warn(raw.isNull(), f"{name}.invalid")
                value = fallback
            raw = F.lower(raw)
        if name == "schedule":
            value = " ".join(value.split()) if len(value.split()) == 5 else fallback
            # white space is single blanks by now
            five = F.size(F.split(raw, " ")) == 5
            warn(raw.isNotNull() & ~five, "schedule.invalid")
            raw = F.when(five, raw)
        if name in ("source_table", "target_table") and not _is_table(value):
            value = fallback
        if name in WARN_MISSING and name not in given:
            warn(F.col(f"__raw_{name}").isNull(), f"{name}.missing")
        fields[name] = F.coalesce(raw, F.lit(value))

    fields["description"] = F.lit(str(given.get("description") or DESCRIPTION).strip() or DESCRIPTION)
    tags = given.get("tags")
    if tags:
        tags = [str(t).strip() for t in (tags.split(",") if isinstance(tags, str) else tags)]
        fields["tags"] = F.array(*[F.lit(t) for t in tags if t]).cast("array<string>")
    else:
        fields["tags"] = F.array(fields["env"])
    fields["warnings"] = F.array_compact(F.array(*warnings))
    out = out.withColumns(fields)
    confidence = F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.round(1.0 - 0.1 * F.size("warnings"), 2)))
    return out.withColumn("confidence", confidence).drop("__text", "__lower", "__job", *captures, *raws)


def _is_table(value: str) -> bool:
    db, dot, table = value.partition(".")
    parts = (db, table)
    return bool(dot) and all(p and p.isascii() and p.replace("_", "a").isalnum() for p in parts)
