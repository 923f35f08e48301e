"""From raw documents to packed sequences: classify, remove near-duplicates and benchmark items, redact secrets, pack.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written and read again before the next. All but the
last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, neardup, packing, quality, secrets
from tallyforge.session import materialise
from tallyforge.sources.files import load_table

VOCABULARY = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for neither junk nor abuse. Null and empty texts are scored like any without words, repeated rows
    alike; of an empty table nothing stays."""
    return quality.kept(docs, load_table(spark, sf_dir, "labels"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that with the smallest doc_id, one without only if none has any.

    Rows are told apart by doc_id and text, so of rows that repeat a doc_id only those in one component are one. Of rows that share
    both, the first by its columns as JSON stays. Rows without words are in no component and all stay. Columns may have any name and type.
    """
    found = materialise(neardup.grouped(docs.select("doc_id", "text")).where(F.col("comp").isNotNull()).groupBy("comp", "doc_id", "tid").agg(
        F.count("*").alias("times")), "pipeline-groups")
    best = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tid"))).alias("best"))
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tid") == F.col("best.tid"))
    marked = found.join(best, "comp").select(F.col("doc_id").alias("of_id"), F.col("tid").alias("of_tid"), first.alias("first"), "times")
    marked = materialise(marked.where(~F.col("first") | (F.col("times") > 1)), "pipeline-extra")
    key = F.xxhash64("of_id", "of_tid").alias("of_key")
    extra, several = (marked.where(c).select("of_id", "of_tid", key) for c in (~F.col("first"), F.col("first")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("tid"))
    rows = rows.withColumn("key", F.xxhash64("id", "tid"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("tid") == F.col("of_tid"))
    # only rows that a bitmap of the others leaves open are shuffled; anti and semi joins would be pushed below the bitmap
    gone = extra.unionByName(several).withColumn("gone", F.lit(True))
    alone = neardup.impossible(rows, gone, "of_key", "key").select("row").unionByName(
        neardup.possible(rows, gone, "of_key", "key").join(gone, same, "left").where("gone is null").select("row"))
    rows = neardup.possible(rows, several, "of_key", "key")
    once = rows.join(several, same).groupBy("id", "tid").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return alone.unionByName(once).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. A null or wordless text contains none, so it stays; repeated rows go or stay alike."""
    return decontaminate.without_items(docs, load_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew; both stay null for a null text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; a null or empty text is its end token, an empty table gives no pieces."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_group), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack)]

#: The classifier is fitted and sequences are filled greedily, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
