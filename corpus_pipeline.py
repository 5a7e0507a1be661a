"""A training corpus from ``documents``: select, deduplicate, decontaminate, mask, mix.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but
the last return the columns of ``documents``; the last adds how often each document is taken.

In every stage: an empty table gives no rows; extra columns, whatever their names, come back as they are
(the mix renames those that are called like its own); a null or empty text is a document without words,
as said below; whole texts are worked on, however long; rows that repeat a document are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.llm import decontaminate, minhash_dedup, pii, quality, source_mix
from sumloom.llm.common import keep_ids, materialize, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 is at least a half. Texts without a trigram have the
    probability of the thresholds alone; rows with a null id are judged and not learned from."""
    return quality.select(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id. Rows that share an id, null
    included, stay together if one of them stays; a group that has null ids only stays. Documents
    without words stay."""
    kept = materialize(minhash_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    return keep_ids(docs, kept, "kept_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without words hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows the text, and stays
    null where it is null. All rows stay."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with size, source_size, target and taken, the words taken of them. Documents
    without words, and those that the draw leaves out, are in no mix. A null source is one of its own."""
    return source_mix.mix(docs, carry=docs.columns).where("taken > 0")


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
