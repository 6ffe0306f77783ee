"""From raw documents to token ids: five stages, each written as Parquet and read again.

Language identification, near-duplicate removal, secret redaction, mixing of
sources, and byte-level BPE.  Each stage calls an operator of ``flowtally.llm``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtally.lineage import cut, new_folder
from flowtally.llm import base, bpe, langid, mixing, secrets, simhash
from flowtally.llm.base import words_of

# mean word marginal under which no single language is accepted
MIN_SCORE = 0.5
# no source is repeated more often than this
MAX_REPEAT = 1.5


def language(spark, docs, sf_dir):
    """Keep documents whose language is found with a score of ``MIN_SCORE`` or more; ``und`` goes.

    The model learns from the labelled rows of its own input, the held-out
    quarter excepted.  Columns are returned as they came.
    """
    crf = langid.fit(docs.where(~langid.held_out()))
    tagged = langid.predict(docs, crf)
    return tagged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keep the document with the smallest id of each SimHash group, and one of its repeated rows.

    Rows that share an id are told apart by their fingerprint: of a group the
    row with the smallest id stays, then the one with the smallest fingerprint,
    then any one of those equal in both.  Rows with a NULL id stay only if
    their group has no row with an id, one row of each group.
    """
    groups = simhash.simhash_groups(docs.select("doc_id", "text"))
    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fingerprint")).alias("low")
    keep = cut(groups.groupBy("group_id").agg(lowest))
    key, mark, rest = base.free_names(docs, "id", "print", "rest")
    one = keep.select(F.col("low.id").alias(key), F.col("low.fingerprint").alias(mark))
    # ids that rows share are rare; without any, no second pass over the texts is needed
    shared = cut(groups.groupBy(F.col("id").alias(key)).agg(F.count("*").alias(rest)).where(F.col(rest) > 1))
    same = F.col("doc_id").eqNullSafe(F.col(key))
    kept = docs.join(one, same, "left_semi")
    if not shared.limit(1).count():
        return kept
    alone = kept.join(shared, same, "left_anti")
    several = simhash.with_fingerprint(kept.join(shared, same, "left_semi"), mark)
    chosen = several.join(one.withColumnRenamed(mark, rest), same & (F.col(mark) == F.col(rest)), "left_semi")
    return alone.union(chosen.dropDuplicates(["doc_id", mark]).select(*docs.columns))


def redact_secrets(spark, docs, sf_dir):
    """Replace every found secret by a mark; the document stays and ``n_chars`` follows its text."""
    found = cut(secrets.scan_new(docs)[0])
    clean = secrets.redact(docs, found)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Flatten the source shares by repeating rows of smaller sources, ``MAX_REPEAT`` times at most; no row is dropped."""
    drawn = mixing.mix(docs, F.size(words_of(F.col("text"))), max_repeat=MAX_REPEAT)
    return drawn.select(*docs.columns)


def tokenize(spark, docs, sf_dir):
    """Token count and digests of the ids and of the text decoded from them, per row."""
    return bpe.digests(docs.select("doc_id", "source", "text"), *bpe.vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

# models, hashing and merges can't be written in SQL; tests hold each stage against plain Python
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; intermediate tables go to the shared folder of the session."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
