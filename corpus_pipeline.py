"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of documents, whatever else these hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterflow.llm import decontamination, line_dedup, ngram_join, packing, quality
from rosterflow.llm.common import table
from rosterflow.session import shared_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them alone; a text that loses all lines is empty."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id."""
    gone = ngram_join.near_duplicates(docs.select("doc_id", "text")).where("component_id <> doc_id")
    gone = gone.select(F.col("doc_id").alias("_rf_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_rf_gone"), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go; so do all rows of their doc_id."""
    found = decontamination.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = found.where("n_hit > 0").select(F.col("doc_id").alias("_rf_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_rf_gone")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", good), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("benchmark decontamination", decontaminated), ("packing", packed)]

# The classifier's scores are not expressible in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
