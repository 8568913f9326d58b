"""The message envelope and routing defaults (SRC-5, MAP-2, MAP-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT = "default"


def wrap(df: DataFrame, seq: Column, partition_by: Column | None = None, batcher: Column | None = None, batch_key: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Rows as messages: seq, payload (the whole row), partition_key, batcher, batch_key, metadata, error.

    ``seq`` is the source offset and carries the order within a key; routing fields may be null or empty.
    """
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return df.select(
        seq.cast("bigint").alias("seq"), F.struct("*").alias("payload"), text(partition_by).alias("partition_key"), text(batcher).alias("batcher"),
        text(batch_key).alias("batch_key"), (metadata if metadata is not None else F.struct("*")).alias("metadata"), F.lit(None).cast("string").alias("error"),
    )


def route(messages: DataFrame) -> DataFrame:
    """Fills batcher and batch key.

    An empty or null batcher or key becomes ``default``; a message with a partition key whose batch key is
    ``default``, even if a handler said so, is batched by its partition key.
    """
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DEFAULT))
    key = filled("batch_key")
    has = F.coalesce(F.col("partition_key"), F.lit("")) != ""
    return messages.withColumn("batcher", filled("batcher")).withColumn("batch_key", F.when(has & (key == DEFAULT), F.col("partition_key")).otherwise(key))
