"""Scalar functions over record columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space, written out because Java's \s covers ASCII only.
SPACE = "\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# Fixed values
ROOT_CAUSES = (
    "OOM",
    "network_timeout",
    "data_corruption",
    "policy_violation",
    "quota_exceeded",
    "unknown",
)
RECURRENCE_RISKS = ("low", "medium", "high")
TRIAGE_CONFIDENCE = 0.55
TRIAGE_SUMMARY = "No summary provided."
TRIAGE_ACTION = "Investigate recent changes and retry."
PROMPT_TOKEN_USD = 0.000001
COMPLETION_TOKEN_USD = 0.000002
GUIDANCE = {
    "plan.no_baseline": "No baseline commit/reference was found. Connect upstream or initialize baseline, then re-run.",
    "plan.no_expected_files": "Planner did not detect expected generated outputs. Check spec/intent and templates.",
    "basic.strict_mode": "Strict mode is enabled; certain warnings are treated as violations. "
    "Adjust advisor options if intended.",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def not_blank(c: Column | str) -> Column:
    """The string, or NULL where it is NULL or only white space."""
    c = _col(c)
    return F.when(F.length(strip(c)) > 0, c)


def filled(c: Column | str) -> Column:
    """The string, or NULL where it is empty."""
    return F.nullif(_col(c), F.lit(""))


def parse_json(text: Column | str) -> Column:
    """VARIANT of a string that holds exactly one JSON value, else NULL.

    ``try_parse_json`` stops after the first value and accepts what follows.
    Text after the value cannot close both a list and an object around it, so
    the value counts only if both wrappings parse.
    """
    t = _col(text)
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
    in_list = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    return F.when(in_object.isNotNull(), F.try_variant_get(in_list, "$[0]", "variant"))


def is_json_object(value: Column | str) -> Column:
    """True for a VARIANT that holds an object; NULL counts as no."""
    return F.coalesce(F.schema_of_variant(_col(value)).startswith("OBJECT"), F.lit(False))


def month_key(ts: Column | str) -> Column:
    """``YYYY-MM``; the session zone is UTC, and NTZ values are taken as UTC."""
    return F.date_format(_col(ts), "yyyy-MM")


def parse_iso_utc(s: Column | str) -> Column:
    """ISO-8601 text to TIMESTAMP, NULL when unparseable; no offset means UTC."""
    # Spark wants the seconds
    text = F.regexp_replace(strip(s), "([T ][0-9]{2}:[0-9]{2})(Z|[+-][0-9]{2}:[0-9]{2})?$", "$1:00$2")
    date = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
    time = "[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?"
    zone = "(Z|[+-][0-9]{2}:[0-9]{2})"
    full = (
        F.when(text.rlike(f"^{date}{time}{zone}$"), text)
        .when(text.rlike(f"^{date}{time}$"), F.concat(text, F.lit("Z")))
        .when(text.rlike(f"^{date}$"), F.concat(text, F.lit("T00:00:00Z")))
    )
    return F.try_to_timestamp(full)


def display_ts(timestamp: Column | str, ts_ms: Column | str) -> Column:
    """The ISO ``timestamp`` if set, else the epoch milliseconds."""
    return F.coalesce(parse_iso_utc(not_blank(timestamp)), F.timestamp_millis(_col(ts_ms)))


def audit_actor(actor: Column | str, user: Column | str) -> Column:
    """``actor`` if present, else ``user``; a dash when empty."""
    return F.coalesce(filled(F.coalesce(_col(actor), _col(user))), F.lit("—"))


def audit_event(event_type: Column | str, event: Column | str, kind: Column | str) -> Column:
    """``event_type``, else ``event``, else ``type``; a dash when empty."""
    return F.coalesce(filled(F.coalesce(_col(event_type), _col(event), _col(kind))), F.lit("—"))


def audit_details(
    details: Column | str,
    message: Column | str,
    http: Column | str,
    record: Column | str,
) -> Column:
    """Text shown for an audit record.

    ``http`` is a struct (method, path, status); ``record`` is the struct
    written out as JSON when nothing else is set.
    """
    h = _col(http)
    request = F.concat(
        F.coalesce(h["method"], F.lit("?")),
        F.lit(" "),
        F.coalesce(h["path"], F.lit("?")),
        F.lit(" ("),
        F.coalesce(h["status"].cast("string"), F.lit("?")),
        F.lit(")"),
    )
    return F.coalesce(not_blank(details), not_blank(message), F.when(h.isNotNull(), request), F.to_json(_col(record)))


def safe_identifier(s: Column | str, variant: str = "plain") -> Column:
    """Replace characters that an identifier may not hold by ``_``.

    ``job`` also collapses and strips ``_``; ``task`` keeps letters and digits
    of every script and cuts at 64 characters.
    """
    if variant == "plain":
        return F.regexp_replace(_col(s), "[^a-zA-Z0-9_\\-]", "_")
    if variant == "job":
        clean = F.regexp_replace(strip(F.coalesce(_col(s), F.lit(""))), "[^a-zA-Z0-9_\\-]", "_")
        clean = F.regexp_replace(F.regexp_replace(clean, "_+", "_"), "^_|_$", "")
        return F.coalesce(filled(clean), F.lit("example_pipeline"))
    if variant == "task":
        raw = F.coalesce(filled(strip(_col(s))), F.lit("llm_task"))
        return F.substring(F.regexp_replace(raw, "[^\\p{L}\\p{N}_\\-]", "_"), 1, 64)
    raise ValueError(f"unknown identifier variant {variant!r}")


def glob_regex(patterns: Sequence[str]) -> str:
    """One anchored regular expression that matches any of the globs."""
    branches = []
    for pattern in patterns:
        out, i = "", 0
        while i < len(pattern):
            ch = pattern[i]
            close = pattern.find("]", i + 2) if ch == "[" else -1
            if ch == "*":
                out += ".*"
            elif ch == "?":
                out += "."
            elif close > 0:
                body = pattern[i + 1 : close]
                negated, body = body.startswith("!"), body.removeprefix("!")
                body = re.sub(r"([\\\[\]^&])", r"\\\1", body)
                out += f"[{'^' if negated else ''}{body}]"
                i = close
            else:
                out += re.escape(ch)
            i += 1
        branches.append(out)
    return "(?s)\\A(?:" + "|".join(branches) + ")\\z"


def glob_match(path: Column | str, patterns: Sequence[str]) -> Column:
    """True where the whole path matches any glob; ``*`` also crosses ``/``."""
    if not patterns:
        return F.lit(False)
    return _col(path).rlike(glob_regex(patterns))


def valid_cron(s: Column | str) -> Column:
    text = strip(F.coalesce(_col(s), F.lit("")))
    return (F.length(text) > 0) & (F.size(F.split(text, f"[{SPACE}]+")) == 5)


def valid_table(s: Column | str) -> Column:
    return strip(F.coalesce(_col(s), F.lit(""))).rlike("\\A[A-Za-z0-9_]+\\.[A-Za-z0-9_]+\\z")


def valid_job_name(s: Column | str) -> Column:
    return F.coalesce(_col(s), F.lit("")).rlike("\\A[A-Za-z0-9_-]{1,128}\\z")


def normalize_path(path: Column | str) -> Column:
    """Replace ids in a request path by placeholders, so that paths can be grouped."""
    p = F.coalesce(filled(path), F.lit("/"))
    # Fixed values, applied in this order
    for pattern, new in (
        ("/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "/:uuid"),
        ("/[0-9a-fA-F]{16,}", "/:hex"),
        ("/[0-9]+", "/:id"),
        ("^(/api/v[12]/modeling)/[^/]+$", "$1/:name"),
        ("^(/api/v1/tenants)/[^/]+/health$", "$1/:tenant/health"),
    ):
        p = F.regexp_replace(p, pattern, new)
    return p


def scope_for_path(path: Column | str, scopes: Sequence[str]) -> Column:
    """First scope that equals the path or is a parent folder of it, else the first scope."""
    rel = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    out = None
    for scope in scopes:
        name = scope.strip().strip("/")
        if name:
            hit = (rel == name) | rel.startswith(name + "/")
            out = F.when(hit, name) if out is None else out.when(hit, name)
    default = F.lit(scopes[0] if scopes else "jobs")
    return default if out is None else out.otherwise(default)


def classify_error(text: Column | str) -> Column:
    """Root cause of a failure text; the first rule that fits wins."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    # Fixed values
    return (
        F.when(t.contains("oom") | t.contains("out of memory"), "OOM")
        .when(t.contains("timeout"), "network_timeout")
        .when(t.contains("policy"), "policy_violation")
        .when(t.contains("quota") | t.contains("budget"), "quota_exceeded")
        .when(t.contains("corrupt"), "data_corruption")
        .otherwise("unknown")
    )


def tokens(text: Column | str) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), f"[{SPACE}]+"), lambda t: F.length(t) > 0)


def token_count(text: Column | str) -> Column:
    """Number of tokens, at least 1."""
    return F.greatest(F.lit(1), F.size(tokens(text)))


def token_cost(prompt: Column | str, completion: Column | str) -> Column:
    """Cost in USD of a call, to 6 decimals."""
    usd = _col(prompt) * F.lit(PROMPT_TOKEN_USD) + _col(completion) * F.lit(COMPLETION_TOKEN_USD)
    return F.round(usd, 6)


def markdown_headers(text: Column | str) -> Column:
    """Trimmed lines whose first character after white space is ``#``."""
    lines = F.transform(F.split(F.coalesce(_col(text), F.lit("")), _LINE_BREAK), strip)
    return F.filter(lines, lambda line: line.startswith("#"))


def explain_finding(
    code: Column | str,
    severity: Column | str,
    message: Column | str,
    target: Column | str,
    guidance: Mapping[str, str] = GUIDANCE,
) -> Column:
    """One line per finding; empty parts are left out."""
    name = F.coalesce(filled(code), F.lit("unknown.code"))
    advice = None
    for key, text in guidance.items():
        advice = F.when(name == key, text) if advice is None else advice.when(name == key, text)
    head = F.concat(F.lit("["), F.coalesce(filled(severity), F.lit("info")), F.lit("] "), name)
    return F.concat_ws(
        " | ",
        head,
        filled(message),
        F.concat(F.lit("Target: "), filled(target)),
        F.concat(F.lit("Guidance: "), advice) if advice is not None else F.lit(None).cast("string"),
    )


def normalize_risk(score: Column | str) -> Column:
    """Scores above 1 are percentages; the result is within 0..1, NULL stays NULL."""
    s = _col(score).cast("double")
    return F.when(s.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(s > 1, s / 100).otherwise(s))))


def normalize_triage(df: DataFrame) -> DataFrame:
    """Clean the five string columns of a triage answer."""
    number = F.expr("try_cast(confidence AS double)")
    cause, risk = F.col("root_cause_class"), F.col("recurrence_risk")
    return df.withColumns(
        {
            "root_cause_class": F.when(cause.isin(*ROOT_CAUSES), cause).otherwise("unknown"),
            "recurrence_risk": F.when(risk.isin(*RECURRENCE_RISKS), risk).otherwise("medium"),
            "confidence": F.greatest(
                F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(TRIAGE_CONFIDENCE)))
            ),
            "human_summary": F.coalesce(filled("human_summary"), F.lit(TRIAGE_SUMMARY)),
            "recommended_action": F.coalesce(filled("recommended_action"), F.lit(TRIAGE_ACTION)),
        }
    )


def numeric_or_null(value: Column | str) -> Column:
    """Double of a VARIANT that holds a JSON number; strings and booleans give NULL."""
    v = _col(value)
    kind = F.schema_of_variant(v)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(v, "$", "double"))
