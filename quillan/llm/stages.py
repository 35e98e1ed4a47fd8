"""The stages of the corpus pipeline, as functions of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, near_dedup, packing, pii
from .common import table

#: A document whose best language profile scores less is in none of the learned languages.
LEAST_SCORE = 0.3
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; all, where nothing can be learned."""
    profiles = language_id.train(docs)
    if not profiles:
        return docs
    judged = language_id.identify(docs, profiles)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    classes = near_dedup.classes(docs, percent=NEAR_PERCENT)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows, ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    return kept if rows == ids else kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised in their texts."""
    out = pii.redact(docs, everywhere=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed training sequences, one row for each piece of a document."""
    return packing.pack(docs)
