"""Secret scans with a ledger of scanned versions.

Every version of a text is addressed by its SHA-256.  A blob is scanned by a
rule once, whatever number of paths or versions hold it; what was scanned is
kept in a ledger of (blob, rule version) and joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtally.lineage import cut
from flowtally.llm.base import column, free_names, query, table


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if ``group`` has ``least`` characters or more.

    ``needs`` is a text that every match holds, or empty; texts without it are
    not searched.  Matches never overlap within a rule and are found from the left.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""

    @property
    def version(self):
        return F.substring(F.sha2(F.lit(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}").cast("binary"), 256), 1, 16)


# Kinds, patterns and lengths, in the order in which equal starts are listed
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run is taken whole, so the least length can stand in the pattern
    Rule("access", "AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def blobs_of(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(path, blob)`` of every row; NULL text is the empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"))


def scan_new(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger has not seen: ``(findings, ledger rows to add)``.

    findings: ``blob, rule_version, kind, ord, start, end`` in code points, end
    exclusive; ledger: ``blob, rule_version``, also for blobs without findings.
    Rank filters run before the shuffle, so copies of one text leave each task
    once.  Offsets are running sums over the pieces between matches, as rows,
    so a text with very many matches needs no large array folds.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(text.alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    one = W.partitionBy("blob").orderBy("blob")
    source = source.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    versions = F.array(*[r.version for r in rules])
    if ledger is None:
        todo = source.withColumn("todo", versions)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        todo = source.join(seen, "blob", "left")
        todo = todo.withColumn("todo", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0).drop("seen")

    def lengths(found):
        return F.transform(found, F.length)

    parts = []
    for i, r in enumerate(rules):
        wanted = F.array_contains("todo", r.version)
        if r.needs:
            wanted = wanted & F.contains(F.col("text"), F.lit(r.needs))
        pattern = F.lit(r.pattern)
        hit = wanted & F.rlike("text", pattern)
        # lengths of the pieces between matches, of matches, and of the group that counts
        part = F.struct(
            F.lit(i).alias("ord"),
            F.lit(r.kind).alias("kind"),
            r.version.alias("rule_version"),
            F.lit(r.least).alias("least"),
            F.arrays_zip(
                lengths(F.split("text", r.pattern, -1)).alias("gap"),
                lengths(F.regexp_extract_all("text", pattern, F.lit(0))).alias("size"),
                lengths(F.regexp_extract_all("text", pattern, F.lit(r.group))).alias("counted"),
            ).alias("m"),
        )
        parts.append(F.when(hit, part))
    rows = todo.select("blob", F.explode(F.array_compact(F.array(*parts))).alias("p"))
    rows = rows.select("blob", "p.ord", "p.kind", "p.rule_version", "p.least", F.posexplode("p.m").alias("i", "m"))
    order = W.partitionBy("blob", "ord").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce(F.col("m.size"), F.lit(0))).over(order)
    rows = rows.select("blob", "ord", "kind", "rule_version", "least", "m", end.alias("end"))
    rows = rows.where(F.col("m.size").isNotNull() & (F.col("m.counted") >= F.col("least")))
    found = rows.select("blob", "rule_version", "kind", "ord", (F.col("end") - F.col("m.size")).alias("start"), "end")
    return found, todo.select("blob", F.explode("todo").alias("rule_version"))


def _by_blob(found: DataFrame) -> DataFrame:
    spans = F.sort_array(F.collect_list(F.struct("start", "ord", "end", "kind")))
    return found.groupBy("blob").agg(spans.alias("spans"))


def findings_by_path(docs: DataFrame, found: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(path, blob, spans)`` for every row; spans are sorted by start, then rule order, and empty where clean."""
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    joined = blobs_of(docs, path_col, text_col).join(_by_blob(found), "blob", "left")
    return joined.select("path", "blob", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one.

    Rows without findings keep their text, NULL included.  Columns stay as they are, whatever their names.
    """
    before = W.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    runs = found.select("blob", "start", "end").withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(before.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    text = column(text_col)
    key, own = free_names(docs, "blob", "runs")
    runs = runs.toDF(key, own)
    blob = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    runs_col = F.col(own)
    # the clean piece before each run, then what follows the last
    from_ = F.transform(runs_col, lambda r, i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs_col, i - 1)["end"]))
    pieces = F.transform(
        F.arrays_zip(runs_col.alias("r"), from_.alias("f")),
        lambda z: F.substring(text, (z["f"] + 1).cast("int"), (z["r"]["start"] - z["f"]).cast("int")),
    )
    rest = F.substring(text, (F.element_at(runs_col, -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.array_join(F.concat(pieces, F.array(rest)), mark)
    new = F.when(runs_col.isNull(), text).otherwise(clean).alias(text_col)
    return docs.withColumn(key, blob).join(runs, key, "left").select(*[new if c == text_col else column(c) for c in docs.columns])


def span_text(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op9_secret_scan")
def op9_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = cut(scan_new(docs)[0])
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings_by_path(docs, found).select(
        F.col("path").alias("doc_id"),
        *[number(kind) for kind in BASE],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )
