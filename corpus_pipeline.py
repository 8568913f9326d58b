"""A training-data pipeline: quality rules, near-duplicates, benchmark passages, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents.

What holds for all stages: documents may be null in any column, repeated, empty or of any length, and may have columns
of any other names, which are kept as they are.  Rows without a ``doc_id`` can't be named by a decision and stay, rows
that share a ``doc_id`` share decisions.  An empty table gives an empty table of the same columns.  Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowline.llm import decontaminate, mixing, quality, secret_scan, simhash
from flowline.llm.shared import drop_documents, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled thresholds reject go.

    Null and empty texts have no words, so they go.  A null ``lang`` is a stratum of its own; without labels the base rules alone decide.
    """
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_documents(docs, judged.where("not kept").select("doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Null and wordless texts are copies of each other; of rows that share a kept id one stays.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none, and null and empty items are held by none; without items all documents stay.
    """
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drop_documents(docs, found.select("doc_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and ``n_chars`` counts the new text.

    A null text stays null, and so does its ``n_chars``; equal texts are redacted alike.
    """
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its own draw say; ``copy`` counts from 1.

    Null and empty texts have size 0 and count in no target; a null ``source`` is a source.  Repeated rows are drawn alike.
    """
    return mixing.emit(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secrets), ("mixing", mix)]

#: The thresholds, links and latent space have no SQL equivalent; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
