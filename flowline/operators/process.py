"""Per-message processing with captured errors (MAP-1, FLT-1, UDF-1, STR-7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def map_columns(messages: DataFrame, error: Column | None = None, **changes: Column) -> DataFrame:
    """The map as column expressions, which stay in generated code; ``error`` is null where a message succeeds."""
    out = messages.withColumns(changes) if changes else messages
    return out.withColumn("error", F.coalesce("error", error.cast("string"))) if error is not None else out


def map_rows(messages: DataFrame, handler: Callable[[dict], dict | None]) -> DataFrame:
    """The map as opaque Python over message dictionaries.

    A handler returns the changed message, or None to keep the message as it was; an exception becomes the
    message's error and leaves it unchanged.  Fields that a handler leaves out keep their values, so
    the envelope is never lost.  Messages that failed before are passed through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row.get("error") is None:
                    try:
                        row = {**row, **(handler(dict(row)) or {})}
                    except Exception as e:  # the handler's own failure is data here
                        row = {**row, "error": f"{type(e).__name__}: {e}"}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return messages.mapInArrow(run, messages.schema)


def succeeded(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("error").isNull())


def failed(messages: DataFrame) -> DataFrame:
    """Failed messages; they are acknowledged one by one and reach no batcher."""
    return messages.where(F.col("error").isNotNull())
