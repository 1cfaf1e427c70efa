"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, tokenizing; each stage's table feeds the next.

Defined results: null and empty texts fail the quality rules; rows of equal id are rows of their own in all stages but the
near duplicates (see there); an empty table gives an empty result; extra columns are not carried; long texts are as each
operator states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import jaccard_join, line_dedup, mixing, quality_rules, sentencepieces
from tilework.llm.common import joined, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the n-gram ratio keep."""
    return quality_rules.judge(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sources' boilerplate lines; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, Jaccard of 0.8): that with the least id. Rows that share an id go
    only if all of them do, so a text that an id shares with a duplicate is never lost; rows without an id stay, and so do empty and
    blank texts, which link with nothing. A very long text's words are held by one task."""
    groups = jaccard_join.jaccard_groups(docs.select("doc_id", "text"), 5, 80)
    stays = groups.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    go = staged(stays.where("not stays").select(F.col("doc_id").alias("id")), "gone")
    return joined(docs, go, F.col("doc_id") == F.col("id"), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix."""
    return sentencepieces.encode(docs).select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_sha256")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("SentencePiece", tokenize)]
#: Hash ratios, thresholds and best paths have no SQL form; tests hold the stages' operators against brute force, and stages by properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
