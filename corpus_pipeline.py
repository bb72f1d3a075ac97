"""Corpus pipeline: five stages over ``documents``, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import Scratch, table
from folioforge.llm.decontaminate import decontaminate
from folioforge.llm.line_dedup import drop_repeated_lines
from folioforge.llm.near_duplicates import one_of_each
from folioforge.llm.packing import pack_documents
from folioforge.llm.quality_classifier import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-equal lines go, and with them documents of which nothing is left."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, place in it, and the bin's final length."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: A trained classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
