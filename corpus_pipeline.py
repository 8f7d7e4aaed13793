"""The training-data pipeline: stages applied in order, each written and read again.

Defined results of every stage: null ids and texts are rows as any other (a null text counts
as empty); repeated rows are judged alike, and only near_duplicates drops any of them; ties
go as the stage's operator says; texts of any length are read whole; extra columns, whatever
their names, stay, but for packing, which returns pieces; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, jaccard_join, packing, quality_crf, secret_owners
from tidelog.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line classifier rejects; without usable labels all stay."""
    return quality_crf.keep_good(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id, null ids last."""
    return jaccard_join.keep_one(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that repeat a benchmark item, by their own text, whatever ids they share."""
    return decontaminate.keep_clean(spark, docs, sf_dir)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks live secrets in the texts; every document stays."""
    return secret_owners.redact(spark, docs, sf_dir)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into training sequences; a null text is its closing id alone."""
    return packing.pack_stage(spark, docs, sf_dir)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", sequences),
]
#: The stages train models and compare sets; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
