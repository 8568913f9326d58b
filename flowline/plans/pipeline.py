"""A pipeline as configuration, run over a table or a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import batching, envelope, outcomes, process
from ..operators.batching import Batcher
from ..streaming import run as streaming
from . import storage


@dataclass(frozen=True)
class Pipeline:
    """What happens to every message.

    ``seq`` and the routing columns are expressions over the source's rows; ``processor`` maps messages to messages
    (:mod:`flowline.operators.process`).  Without batchers, messages are acknowledged after processing; with
    them, a batch handler decides, and a handler of None accepts its batches.  An empty list counts as none.
    """

    seq: Column
    partition_by: Column | None = None
    batcher: Column | None = None
    batch_key: Column | None = None
    processor: Callable[[DataFrame], DataFrame] = lambda messages: messages
    batchers: tuple[Batcher, ...] = ()
    handlers: dict[str, Callable[[pd.DataFrame], pd.DataFrame | None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len({b.name for b in self.batchers}) < len(self.batchers):
            raise ValueError("batchers need different names")

    def _processed(self, source: DataFrame) -> DataFrame:
        return self.processor(envelope.wrap(source, self.seq, self.partition_by, self.batcher, self.batch_key))

    def outcomes(self, source: DataFrame) -> DataFrame:
        """(seq, status, error), one row for each row of ``source``.

        Processed messages are written once and read by every branch, so that a processor which isn't deterministic can't give a
        message two outcomes or none; all batchers' handlers run in one pass.
        """
        done = self._processed(source)
        if not self.batchers:
            return outcomes.of(done)
        done, _ = storage.written(envelope.route(done), "processed")
        table = batching.table(source.sparkSession, list(self.batchers))
        routed = process.succeeded(done)
        batched = batching.assign(batching.known(routed, table))
        out = outcomes.of(process.failed(done)).unionByName(outcomes.of(batching.unknown(routed, table)))
        return out.unionByName(batching.handle(batched, self.handlers))

    def start(self, stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """The same over a stream; outcomes go to ``path``.

        Batches fill up over micro-batches and are handed on when they are full or when their first message has waited for the
        batcher's timeout.  When a drained or stopped stream won't go on, :meth:`flush` hands on what still waits.
        """
        done = self._processed(stream)
        if not self.batchers:
            return streaming.sink(outcomes.of(done), path, checkpoint, interval=interval)
        return streaming.sink(streaming.handled(envelope.route(done), self.batchers, self.handlers), path, checkpoint, interval=interval)

    def flush(self, spark: SparkSession, path: str, checkpoint: str) -> None:
        """Hands on the incomplete batches of a stopped stream: their outcomes join those in ``path``.  The stream can't be resumed after it."""
        left = streaming.flushed(spark, checkpoint, self.handlers)
        left.write.mode("overwrite").parquet(f"{path}/batch_id=-1")
