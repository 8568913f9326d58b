"""Every message's outcome (SNK-1, SNK-3, AGG-6, SET-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

OK, FAILED = "ok", "failed"


def of(messages: DataFrame) -> DataFrame:
    """(seq, status, error) of processed messages."""
    return messages.select("seq", F.when(F.col("error").isNull(), OK).otherwise(FAILED).alias("status"), "error")


def counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def unacked(sent: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Messages in flight: sent, without an outcome."""
    return sent.join(outcomes.select("seq"), "seq", "left_anti")
