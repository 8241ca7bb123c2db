"""The corpus pipeline: five stages, each working on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame; run() writes each as Parquet to the shared
folder and reads it back as the next stage's docs. The first four return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmetrics.llm import exact_dedup, jaccard_join, packing, quality_rules, secret_scan
from panelmetrics.llm.common import scratch, tables_folder, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted are those labelled 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.drop_rejected(docs, labels.where("quality = 1").select("doc_id"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.keep_one_of_class(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials replaced; n_chars follows the text."""
    cleaned = secret_scan.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in a training sequence, and its text."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

# The first and the last stage have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes on its way goes when its result is written."""
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_folder(spark)
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "stage", results)
    return STAGES[-1][1](spark, docs, sf_dir)
