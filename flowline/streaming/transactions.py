"""Transactions assembled over a stream: rows are held from their arrival to their commit, over micro-batches (SRC-8, CDC-6).

Neighbouring transactions share a state, so one call of Python serves many and most of them, which end in the micro-batch of their changes, never touch the store.
The rows of others wait in it in pieces, which it keeps on disk; a micro-batch writes the rows that it brings and nothing twice.  At the commit they
leave together with its lsn, at an abort or when the transaction has been silent for too long they go.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

# Kinds of events.
CHANGE, COMMIT, ABORT = "change", "commit", "abort"

#: Rows that a task holds of a state's transactions before it writes them to the store.
ROWS = 10_000
#: Binary digits of a transaction's number in which those that share a state differ.
NEAR = 10


class Assembler(StatefulProcessor):
    """Holds the rows of one slice of neighbouring transactions; ``schema`` is theirs, ``silence_ms`` how long one may be without an event."""

    def __init__(self, schema: StructType, silence_ms: int | None):
        self.schema, self.silence_ms = schema, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        xid = self.schema["xid"].dataType.simpleString()
        self.handle = handle
        self.rows = handle.getMapState("rows", f"xid {xid}, piece long", "n long, packed binary")
        self.waits = handle.getValueState("waits", f"xids array<{xid}>, pieces array<long>, since array<long>")

    def close(self) -> None:
        pass

    def _waiting(self) -> dict:
        """{xid: (pieces in the store, time of its last event)}."""
        xids, pieces, since = (self.waits.get() if self.waits.exists() else None) or ((), (), ())
        return {x: (int(p), int(t)) for x, p, t in zip(xids, pieces, since)}

    def _keep(self, waiting: dict) -> None:
        if waiting:
            self.waits.update((list(waiting), [p for p, _ in waiting.values()], [t for _, t in waiting.values()]))
        else:
            self.waits.clear()
        if self.silence_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if waiting:
                self.handle.registerTimer(min(t for _, t in waiting.values()) + self.silence_ms)

    def _removed(self, xid: object, pieces: int) -> None:
        for piece in range(pieces):
            self.rows.removeKey((xid, piece))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        """Changes and ends come in any order within a micro-batch; a transaction has one end, after all its changes."""
        waiting, fresh, ends, n = self._waiting(), {}, {}, 0
        before = dict(waiting)
        now = timerValues.getCurrentProcessingTimeInMs() if self.silence_ms is not None else 0

        def stored() -> None:
            for xid, held in fresh.items():
                pieces = waiting.get(xid, (0, 0))[0]
                self.rows.updateValue((xid, pieces), (len(held), pickle.dumps(held)))
                waiting[xid] = (pieces + 1, now)
            fresh.clear()

        names = self.schema.names
        for row in rows:
            if row["kind"] != CHANGE:
                ends[row["xid"]] = (row["kind"], row["lsn"])
                continue
            fresh.setdefault(row["xid"], []).append(tuple(row[c] for c in names))
            n += 1
            if n == ROWS:
                stored()
                n = 0
        told = Row(*names, "commit_lsn")
        for xid, (kind, lsn) in ends.items():
            pieces, last = waiting.pop(xid, (0, 0))[0], fresh.pop(xid, ())
            if kind == COMMIT:
                for piece in range(pieces):
                    for held in pickle.loads(self.rows.getValue((xid, piece))[1]):
                        yield told(*held, lsn)
                for held in last:
                    yield told(*held, lsn)
            self._removed(xid, pieces)
        stored()
        if waiting != before:
            self._keep(waiting)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        """A transaction that has been silent for too long goes as an aborted one does."""
        waiting, now = self._waiting(), timerValues.getCurrentProcessingTimeInMs()
        for xid, (pieces, since) in list(waiting.items()):
            if since + self.silence_ms <= now:
                self._removed(xid, pieces)
                del waiting[xid]
        self._keep(waiting)
        return iter(())


def assembled(events: DataFrame, silence_ms: int | None = None, slices: int = 1) -> DataFrame:
    """Changes of committed transactions with their ``commit_lsn``, from a stream of events in any micro-batches; all rows of a transaction come out in that of its commit.

    ``events`` has place, kind, xid (a whole number), lsn (a commit's is the transaction's) and the changes' columns; the order within a transaction is that of ``place``.
    With ``slices``, rows of one transaction are spread over so many states and its end is handed to each, so that one with a third of all
    rows isn't one task's; a checkpoint keeps its number.  Order what a micro-batch brings by (commit_lsn, place): commits of later ones come later.
    """
    rest = [f for f in events.schema.fields if f.name != "kind"]
    spread = events
    if slices > 1:
        own = F.array(F.pmod(F.xxhash64("place"), F.lit(slices)).cast("int"))
        spread = events.withColumn("slice", F.explode(F.when(F.col("kind") == CHANGE, own).otherwise(F.sequence(F.lit(0), F.lit(slices - 1)))))
    else:
        spread = events.withColumn("slice", F.lit(0))
    out = StructType([*rest]).add("commit_lsn", "long")
    mode = "none" if silence_ms is None else "processingTime"
    return spread.withColumn("near", F.shiftright("xid", NEAR)).groupBy("near", "slice").transformWithState(Assembler(StructType(rest), silence_ms), out, "append", mode)


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(xid, slice, n): rows that a stopped stream still holds of transactions without an end."""
    state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
    return state.groupBy("user_map_key.xid", "key.slice").agg(F.sum("user_map_value.n").alias("n"))
