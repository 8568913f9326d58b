"""Merging snapshot reads with the change log (CDC-1 to CDC-6, CDC-10, JOIN-1, JOIN-2, SET-1, SET-3).

A change is emitted if its key's range has been scanned and its transaction may not have been
visible to that scan (xid >= xmin): at least once, never lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import in_range, uuid_place
from ..operators.numbering import interval_lookup
from .wal import DELETE, READ

EMIT, STALE, UNSCANNED, BUFFER = "emit", "discard_stale", "discard_unscanned", "buffer"


def _place(changes: DataFrame) -> Callable[[Column], Column]:
    """How the interval join places keys: whole numbers as they are, UUIDs by their first bits."""
    return uuid_place if dict(changes.dtypes)["pk"] == "string" else lambda c: c


def verdicts(changes: DataFrame, scanned: DataFrame, streaming: bool = False, current: tuple[str, int | None, int | None] | None = None) -> DataFrame:
    """``changes`` (table, pk, xid ...) with chunk_id, xmin and ``verdict``.

    ``scanned`` has table, chunk_id, low, high, xmin, disjoint within a table.  ``current`` is the chunk being read
    (table, low, estimated high): its changes are buffered.  Once streaming, all are emitted.  Keys are whole numbers
    or canonical UUIDs.
    """
    found = interval_lookup(changes, scanned, "table", "pk", "low", "high", ["chunk_id", "xmin"], _place(changes))
    reading = F.lit(False)
    if current is not None:
        table, low, high = current
        point = F.col("pk")
        reading = (F.col("table") == table) & (F.lit(True) if low is None else point > low) & (F.lit(True) if high is None else point <= high)
    verdict = F.when(F.lit(streaming), EMIT).when(F.col("chunk_id").isNotNull(), F.when(F.col("xid") >= F.col("xmin"), EMIT).otherwise(STALE)).when(F.coalesce(reading, F.lit(False)), BUFFER).otherwise(UNSCANNED)
    return found.withColumn("verdict", verdict)


def settle(buffered: DataFrame, table: str, low: int | None, high: int | None, xmin: int) -> tuple[DataFrame, DataFrame]:
    """At a chunk's end: (changes to emit, changes carried on) of those buffered.

    Inside (low, high] of the chunk's own table, changes at or above xmin are emitted and others dropped; changes beyond the
    chunk's actual end, or of other tables, are carried to the next chunk.
    """
    inside = (F.col("table") == table) & (F.lit(True) if low is None else F.col("pk") > low) & (F.lit(True) if high is None else F.col("pk") <= high)
    inside = F.coalesce(inside, F.lit(False))
    return buffered.where(inside & (F.col("xid") >= xmin)), buffered.where(~inside)


def replay(changes: DataFrame, chunks: DataFrame, complete_at: int | None) -> DataFrame:
    """What each change of a mixed run comes to: ``changes`` with ``verdict`` emit, discard_stale, discard_unscanned or buffer.

    ``changes`` has place (arrival), table, pk, xid; ``chunks`` has table, chunk_id, begin, end (places), low, estimated, high, xmin,
    with a null end while a chunk is read; ``complete_at`` is where the snapshot completed, or null.
    A change that arrives after its range is scanned is judged at once.  One that arrives while a chunk whose
    estimated range holds it is read is buffered, then judged by the first chunk, from that one on, whose actual range holds it; without
    one it is emitted when the snapshot completes, else it waits.  Any other change before completion is discarded.

    Chunks of a table have disjoint actual ranges, and one chunk is read at a time, so both look-ups are interval joins: the
    chunk whose actual range holds the key, and the chunk that was being read when the change arrived.
    """
    pk, place = F.col("pk"), F.col("place")
    ended = chunks.where(F.col("end").isNotNull()).select("table", "low", "high", F.col("begin").alias("_its_begin"), F.col("end").alias("_its_end"), F.col("xmin").alias("_its_xmin"))
    read = chunks.select(F.lit(1).alias("_all"), F.col("begin").alias("_from"), (F.col("end") - 1).alias("_to"), F.col("table").alias("_now_table"), F.col("low").alias("_now_low"), F.col("estimated").alias("_now_high"))
    read = read.withColumn("_now", F.struct("_now_table", "_now_low", "_now_high", F.col("_from").alias("begin")))
    found = interval_lookup(changes, ended, "table", "pk", "low", "high", ["_its_begin", "_its_end", "_its_xmin"], _place(changes))
    found = interval_lookup(found.withColumn("_all", F.lit(1)), read, "_all", "place", "_from", "_to", ["_now"])
    now = F.col("_now")
    buffered = now.isNotNull() & (now["_now_table"] == F.col("table")) & in_range(pk, now["_now_low"], now["_now_high"])
    judged = F.when(F.col("xid") >= F.col("_its_xmin"), EMIT).otherwise(STALE)
    finished = F.lit(complete_at is not None)
    verdict = (
        F.when(finished & (place > F.lit(complete_at if complete_at is not None else 0)), EMIT)
        .when(F.col("_its_end") < place, judged)
        .when(~F.coalesce(buffered, F.lit(False)), UNSCANNED)
        .when(F.col("_its_begin") >= now["begin"], judged)
        .otherwise(F.when(finished, EMIT).otherwise(BUFFER))
    )
    return found.withColumn("verdict", verdict).drop("_all", "_now", "_its_begin", "_its_end", "_its_xmin")


def stream(reads: DataFrame, judged: DataFrame) -> DataFrame:
    """Snapshot reads and emitted changes in one table (table, pk, op, lsn); reads have no lsn and come before any change."""
    columns = ["table", "pk", "op", "lsn"]
    read = reads.select("table", "pk", F.lit(READ).alias("op"), F.lit(None).cast("bigint").alias("lsn"))
    return read.unionByName(judged.where(F.col("verdict") == EMIT).select(*columns))


def overflow(judged: DataFrame, chunk_plan: DataFrame) -> DataFrame:
    """Changes beyond the last scanned key of their table, which are emitted when the snapshot completes; the plan's tables are few."""
    ends = chunk_plan.groupBy("table").agg(F.max("hi").alias("_last"))
    return judged.join(F.broadcast(ends), "table").where(F.col("pk") > F.col("_last")).drop("_last")


def apply(events: DataFrame, order: Column | None = None) -> DataFrame:
    """Current rows after all events: the last event of each (table, pk), reads first, unless it deletes.

    Changes are in order of lsn and, where the events have that column, of ``place`` in their transaction, since all changes of
    a transaction may carry the lsn of its commit.
    Only the greatest event per key is kept in partial aggregates, so a key with very many events is no burden.
    """
    lsn = F.coalesce("lsn", F.lit(-1).cast("bigint"))
    last = order if order is not None else F.struct(lsn, F.coalesce("place", F.lit(-1).cast("bigint"))) if "place" in events.columns else lsn
    others = [c for c in events.columns if c not in ("table", "pk")]
    newest = events.groupBy("table", "pk").agg(F.max_by(F.struct(*others), last).alias("_e"))
    return newest.where(F.col("_e")["op"] != DELETE).select("table", "pk", "_e.*")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, as an upsert leaves it; one row per key is kept in partial aggregates."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")
