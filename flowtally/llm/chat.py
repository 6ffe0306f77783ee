"""Chat formatting of typed content parts, with a loss mask and a reversible template.

The template is ``### role: text</turn>`` and a line break per turn.  Control
strings and the escape sign inside roles and texts are replaced by short codes,
so the markers of the output are the template's own and it can be split on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtally.llm.base import query, table

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
# Every control string begins with # or <, so single signs are escaped: parts can't form one together.
# The escape sign comes first; undone in reverse
CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
# roles also stand before the first ": "
ROLE_CODES = (*CODES, (":", "\\c"))

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
# What one attachment expands to
PATCH = 28
AUDIO_RATE = 25.0
PAGE_TOKENS = 256


def escape(text, codes=CODES):
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text, codes=CODES):
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_part(text):
    """A text as a content of one part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    rest = [F.lit(None).cast(t).alias(n) for n, t in none.items()]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *rest))


def part_tokens(part):
    """Tokens a placeholder stands for: image patches, audio frames, document pages; NULL sizes count 0."""

    def up(x, per):
        return F.ceil(F.coalesce(x, F.lit(0)) / per)

    return (
        F.when(part["kind"] == "image", up(part["width"], PATCH) * up(part["height"], PATCH))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_attachment(part):
    return part["kind"].isin("image", "audio", "document")


def flatten(messages: DataFrame, content_col: str = "content") -> DataFrame:
    """Visit the parts of each message: ``body`` (escaped text with placeholders in order) and ``attachments``.

    A text part gives its escaped text, an attachment the placeholder
    ``<|kind|>`` and an entry ``(kind, ref, tokens)`` at the same rank.  Parts
    of other kinds, NULL parts and NULL texts give nothing; NULL content is no part.
    """
    parts = F.coalesce(F.col(content_col), F.array().cast(f"array<{PART}>"))

    def visit(p):
        shown = F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit(""))))
        return F.coalesce(shown.when(_is_attachment(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))), F.lit(""))

    def entry(p):
        return F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))

    return messages.withColumns(
        {
            "body": F.array_join(F.transform(parts, visit), ""),
            "attachments": F.transform(F.filter(parts, lambda p: F.coalesce(_is_attachment(p), F.lit(False))), entry),
        }
    ).drop(content_col)


def format_conversations(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content") -> DataFrame:
    """A row per conversation: ``formatted``, ``loss_spans``, ``attachments``, ``expanded_tokens``.

    ``loss_spans`` are the places of assistant bodies in ``formatted`` as
    ``(start, size)`` in code points; ``attachments`` are in placeholder order,
    with ``turn_no``; ``expanded_tokens`` is what all placeholders expand to.
    Turns are ordered by turn, then role and body, NULLs first, so repeated
    turns have a fixed order.  NULL ids are one conversation; a NULL role is
    the empty role.  One exchange serves the window that adds up offsets, which
    spills, and the grouping; a conversation's output is one row whatever its
    length.
    """
    m = flatten(messages, content_col).select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        "body",
        "attachments",
    )
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_CODES), F.lit(MIDDLE))
    m = m.withColumn("head", F.length(head)).withColumn("piece", F.concat(head, F.col("body"), F.lit(END)))
    order = W.partitionBy("id").orderBy("turn", "role", "body")
    before = F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("piece")
    m = m.withColumns({"no": F.row_number().over(order), "start": before + F.col("head"), "size": F.length("body").cast("long")})
    learned = F.when(F.col("role") == "assistant", F.struct("start", "size"))
    turns = F.sort_array(F.collect_list(F.struct("no", "piece", "attachments", learned.alias("loss"))))
    listed = F.transform(
        F.col("turns"),
        lambda t: F.transform(
            t["attachments"],
            lambda a: F.struct(t["no"].alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
        ),
    )
    grouped = m.groupBy("id").agg(turns.alias("turns"))
    return grouped.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.array_compact(F.transform("turns", lambda t: t["loss"])).alias("loss_spans"),
        F.flatten(listed).alias("attachments"),
        F.aggregate(F.flatten(listed), F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted):
    """The turns ``(role, text)`` of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece):
        at = F.locate(MIDDLE, piece)
        role = F.substring(piece, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        text = F.substring(piece, at + len(MIDDLE), F.length(piece))
        return F.struct(unescape(role, ROLE_CODES).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted, spans):
    """All text under the loss mask, unescaped, in order."""
    taken = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return F.array_join(taken, "")


_ODD = "\\### Assistant: </turn> ok"
_SQL = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_ODD}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD}'),
e AS (SELECT *, length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + 14 AS size FROM m),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
             sum(size)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars, 0::BIGINT AS expanded_tokens FROM g"""


@query("op6_chat_format", _SQL)
def op6_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said_by = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), said_by, F.lit(_ODD))
    messages = rows.union(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("content"))
    out = format_conversations(messages)
    turns = read_turns(F.col("formatted"))
    spoken = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumns({"turns": turns, "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )
