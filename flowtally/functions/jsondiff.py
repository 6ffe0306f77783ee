"""Key-path difference of two JSON documents, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.scalars import parse_json

# The keys of a value if it is an object, else NULL
_KEYS = "try_variant_get({v}, '$', 'map<string,variant>')"

# Two values of one key: open if both are objects, else compared
_SETTLE = """named_struct(
  '__path', {path}, '__a', s.a, '__b', s.b, '__ma', s.ma, '__mb', s.mb,
  '__open', s.in_a AND s.in_b AND s.ma IS NOT NULL AND s.mb IS NOT NULL,
  'change', CASE WHEN NOT s.in_a THEN 'added' WHEN NOT s.in_b THEN 'removed'
                 WHEN (s.ma IS NULL OR s.mb IS NULL) AND {differs} THEN 'modified' END)"""

_ROOT = """
SELECT {columns} inline(transform(array(named_struct(
  'in_a', true, 'in_b', true, 'a', __x, 'b', __y, 'ma', {keys_x}, 'mb', {keys_y})), s -> {settle}))
FROM {{parsed}}
"""

# Replace open pairs by the pairs of their keys; settled rows pass through
_LEVEL = """
SELECT {columns} inline(IF(__open,
  filter(
    transform(
      transform(array_union(map_keys(__ma), map_keys(__mb)), k -> named_struct(
        'k', k, 'in_a', map_contains_key(__ma, k), 'in_b', map_contains_key(__mb, k),
        'a', __ma[k], 'b', __mb[k], 'ma', {keys_a}, 'mb', {keys_b})),
      s -> {settle}),
    e -> e.__open OR e.change IS NOT NULL),
  array(named_struct('__path', __path, '__a', __a, '__b', __b, '__ma', __ma, '__mb', __mb,
                     '__open', __open, 'change', change))))
FROM level{below}
"""


_LEVELS = 4
_NUMBER = "schema_of_variant({v}) RLIKE '^(BIGINT|DOUBLE|DECIMAL)'"
# strings, numbers, and all else between them, of a text that has sorted keys and no white space
_TOKENS = r"""regexp_extract_all(to_json({v}), r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.E+-]*+|[^"0-9-]++', 0)"""
_PLAIN = "regexp_replace(regexp_replace({t}, '([.][0-9]*?)0+$', '$1'), '[.]$', '')"


def _differs(a: str, b: str) -> str:
    """SQL that is true for two different values.

    Numbers are equal by value: a number with an exponent or many digits is a
    double and compared as one, others digit by digit without trailing zeros.
    Lists, and whatever lists hold at any depth, are compared token by token of
    their sorted texts: numbers in them are equal if their digits are, or, where
    one is written with an exponent, if their doubles are.
    """
    text_a, text_b = f"to_json({a})", f"to_json({b})"
    doubles = f"NOT (try_variant_get({a}, '$', 'double') <=> try_variant_get({b}, '$', 'double'))"
    plain = f"{_PLAIN.format(t=text_a)} <> {_PLAIN.format(t=text_b)}"
    exact = f"(schema_of_variant({a}) <> 'DOUBLE' AND schema_of_variant({b}) <> 'DOUBLE' AND {plain})"
    number = "p RLIKE '^[-0-9]' AND q RLIKE '^[-0-9]'"
    value = "(contains(p, 'E') OR contains(q, 'E')) AND try_cast(p AS double) = try_cast(q AS double)"
    same = f"p = q OR ({number} AND ({_PLAIN.format(t='p')} = {_PLAIN.format(t='q')} OR ({value})))"
    # a shorter side is filled up with NULL, which is no equal token
    tokens = f"exists(zip_with({_TOKENS.format(v=a)}, {_TOKENS.format(v=b)}, (p, q) -> coalesce(NOT ({same}), true)), x -> x)"
    return f"""(CASE WHEN {text_a} = {text_b} THEN false
      WHEN {_NUMBER.format(v=a)} AND {_NUMBER.format(v=b)} THEN {doubles} OR {exact}
      WHEN {text_a} LIKE '[%' AND {text_b} LIKE '[%' THEN {tokens}
      ELSE {text_a} <> {text_b} END)"""


def object_depth(text: Column | str) -> Column:
    """How deeply objects are nested in a JSON text; braces inside strings don't count."""
    text = F.col(text) if isinstance(text, str) else text
    return _nesting(_braces(text))


def _braces(text: Column) -> Column:
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    return F.regexp_replace(bare, "[^{}]+", "")


def _nesting(braces: Column) -> Column:
    braces = F.split(braces, "")

    def step(s, c):
        now = s["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def json_diff(df: DataFrame, before: str, after: str, depth: int | None = None) -> DataFrame:
    """One row per differing key path: the other input columns, ``path`` and ``change``.

    Both documents stay in their row: each level turns two objects into one
    row per key that may differ, so nothing is joined or shuffled.  A subtree
    found on one side only is reported at its top key, lists are compared as a
    whole by the values they hold at any depth, and ``$`` stands for a differing
    root.  Objects are followed to any depth: the plan has as many levels as the deepest pair of the data, which a
    first pass over the texts measures (one number).  A caller who knows a
    bound passes ``depth`` and saves that pass; a deeper pair then fails the
    job.  Rows where a side is missing or no valid JSON give nothing;
    ``json_parseable`` tells them apart.
    """
    kept = [c for c in df.columns if c not in (before, after)]
    if depth is None:
        # documents of one shape are folded once; combined before the shuffle
        shapes = df.select(_braces(F.col(before)).alias("x"), _braces(F.col(after)).alias("y")).distinct()
        depth = shapes.agg(F.max(F.least(_nesting(F.col("x")), _nesting(F.col("y"))))).first()[0] or 0
    # a side that is NULL compares to NULL and drops out at the end; a filter
    # here would be pushed below the projection and parse everything twice
    parsed = df.select(*kept, parse_json(before).alias("__x"), parse_json(after).alias("__y"))
    # a few levels per statement: one for all would take the analyzer too many rounds, one each analyzes too often
    columns = "".join(f"`{c}`, " for c in kept)
    differs = _differs("s.a", "s.b")
    root = _ROOT.format(
        columns=columns,
        keys_x=_KEYS.format(v="__x"),
        keys_y=_KEYS.format(v="__y"),
        settle=_SETTLE.format(path="''", differs=differs),
    )
    session = df.sparkSession
    rows = session.sql(root, parsed=parsed)
    settle = _SETTLE.format(path="IF(__path = '', s.k, concat(__path, '.', s.k))", differs=differs)
    keys = {"keys_a": _KEYS.format(v="__ma[k]"), "keys_b": _KEYS.format(v="__mb[k]")}
    for at in range(0, depth, _LEVELS):
        count = min(_LEVELS, depth - at)
        levels = ["level0 AS (SELECT * FROM {rows})"]
        levels += [f"level{i + 1} AS ({_LEVEL.format(columns=columns, settle=settle, below=i, **keys)})" for i in range(count)]
        rows = session.sql(f"WITH {', '.join(levels)} SELECT * FROM level{count}", rows=rows)
    change = F.when(F.col("__open"), F.raise_error(F.lit("json_diff: objects are nested deeper than depth"))).otherwise(F.col("change"))
    path = F.when(F.col("__path") == "", "$").otherwise(F.col("__path"))
    return rows.select(*kept, path.alias("path"), change.alias("change")).where(F.col("change").isNotNull())


def json_parseable(before: str, after: str) -> Column:
    """True where both sides hold valid JSON."""
    return parse_json(before).isNotNull() & parse_json(after).isNotNull()
