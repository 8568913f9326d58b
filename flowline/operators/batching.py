"""Routing to named batchers, batches by count, batch handlers (RT-1, RT-2, WIN-1 to WIN-6, AGG-1, UDF-2, STR-8, STR-10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .numbering import numbered
from .outcomes import FAILED, OK

#: Messages of a batch, and seconds that an incomplete batch waits.
BATCH_SIZE, BATCH_TIMEOUT = 100, 3.0


#: What a batch's messages go through: it returns those that it processed.
Handler = Callable[[pd.DataFrame], pd.DataFrame | None] | None


@dataclass(frozen=True)
class Batcher:
    name: str = "default"
    batch_size: int = BATCH_SIZE
    batch_timeout: float = BATCH_TIMEOUT
    concurrency: int = 1

    def __post_init__(self) -> None:
        if self.batch_size < 1 or self.concurrency < 1:
            raise ValueError("batch_size and concurrency must be at least 1")


def table(spark: SparkSession, batchers: list[Batcher]) -> DataFrame:
    return spark.createDataFrame([(b.name, b.batch_size) for b in batchers], "batcher string, batch_size int")


def known(messages: DataFrame, batchers: DataFrame) -> DataFrame:
    """Messages with their batcher's ``batch_size``; the configuration is a few rows."""
    return messages.join(F.broadcast(batchers), "batcher")


def unknown(messages: DataFrame, batchers: DataFrame) -> DataFrame:
    """Messages for batchers that aren't configured, as failures: none is lost without an outcome."""
    lost = messages.join(F.broadcast(batchers), "batcher", "left_anti")
    return lost.withColumn("error", F.coalesce("error", F.concat(F.lit("unknown batcher: "), F.col("batcher"))))


def assign(messages: DataFrame, batch_size: int | None = None) -> DataFrame:
    """``messages`` with ``batch_no`` from 0: the first ``batch_size`` by seq of each batcher and key, then the next.

    The last batch of a key holds what remains; no batch is larger than its size.
    """
    size = F.lit(batch_size) if batch_size is not None else F.col("batch_size")
    return numbered(messages, ["batcher", "batch_key"], "seq", "_place").withColumn("batch_no", F.floor(F.col("_place") / size).cast("bigint")).drop("_place")


def sizes(batched: DataFrame) -> DataFrame:
    """(batcher, batch_key, batch_no, n, lo, hi): each batch's messages and first and last seq."""
    return batched.groupBy("batcher", "batch_key", "batch_no").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))


def lists(batched: DataFrame) -> DataFrame:
    """(batcher, batch_key, batch_no, seqs): each batch's seqs in order; a list is at most one batch."""
    seqs = F.transform(F.array_sort(F.collect_list("seq")), lambda s: s.cast("string"))
    return batched.groupBy("batcher", "batch_key", "batch_no").agg(F.array_join(seqs, ",").alias("seqs"))


def judged(batch: pd.DataFrame, handler: Handler) -> tuple[list[str], list[str | None]]:
    """Statuses and errors of a batch's messages after its handler; None as a handler accepts all."""
    if handler is None:
        return [OK] * len(batch), [None] * len(batch)
    try:
        done, error = handler(batch.copy()), None
    except Exception as e:  # the handler's own failure is data here
        done, error = None, f"{type(e).__name__}: {e}"
    back = set() if done is None else set(done["seq"])
    ok = [s in back for s in batch["seq"]]
    return [OK if x else FAILED for x in ok], [None if x else error or "not returned by its batch" for x in ok]


def handle(batched: DataFrame, handlers: Handler | dict[str, Handler]) -> DataFrame:
    """Outcomes (seq, status, error) of every message after its batch's handler.

    ``handlers`` is one for all batches or one for each batcher; a batcher without one accepts its batches.  A handler
    gets a batch's messages in order of seq and returns those it processed.  Messages it doesn't return, and all of a batch
    whose handler raises, fail; so every message has one outcome.  Batches are dealt to tasks whole and cut from
    sorted rows, so a call of Python handles many of them.
    """
    of = handlers.get if isinstance(handlers, dict) else lambda _: handlers
    keys = ["batcher", "batch_key", "batch_no"]
    dealt = batched.withColumn("_batch", F.to_json(F.struct(*keys))).repartition("_batch").sortWithinPartitions("_batch", "seq")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def outcome(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
            """Outcomes of the batches in ``rows`` that are whole, and the rows of the last one if more of it may come."""
            names = rows["_batch"].to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(rows)] if len(rows) else [0]
            plain, statuses, errors = rows.drop(columns="_batch"), [], []
            whole = cuts if last else cuts[:-1]
            for a, b in zip(whole, whole[1:]):
                batch = plain.iloc[a:b].reset_index(drop=True)
                status, error = judged(batch, of(batch["batcher"].iloc[0]))
                statuses += status
                errors += error
            done = pd.DataFrame({"seq": plain["seq"].iloc[: whole[-1]].astype("int64"), "status": pd.Series(statuses, dtype=object, index=plain.index[: whole[-1]]), "error": pd.Series(errors, dtype=object, index=plain.index[: whole[-1]])})
            return done, None if last else rows.iloc[whole[-1] :]

        for part in parts:
            if len(part):
                done, held = outcome(part if held is None or not len(held) else pd.concat([held, part], ignore_index=True), False)
                if len(done):
                    yield done
        if held is not None and len(held):
            yield outcome(held.reset_index(drop=True), True)[0]

    return dealt.mapInPandas(run, "seq long, status string, error string")
