"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, and the mix.

Each stage takes (spark, docs, sf_dir) and returns documents for the next one; the last returns the
documents that are drawn with `copies`, how often each is read.

Edge cases: null texts and texts without words pass all filters but the classifier, whose features of
them are zero, and count no tokens in the mix; repeated rows are copies of which one stays; null ids,
sources and languages are values like others; empty tables stay empty through all stages; other columns
pass through whatever their names, but one named `copies` gives way to the mix's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import decontaminate, jaccard_join, mixing, pii, quality
from furrow.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that similarity links join."""
    return jaccard_join.keep_first(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, n_chars brought up to date."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that target weights draw, and how often."""
    return mixing.select(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("decontamination", keep_clean), ("personal_data", mask_personal), ("mixing", mix_sources)]

#: The classifier is not for SQL to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
