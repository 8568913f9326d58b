"""The merger as a stream: snapshot chunks and the change log, interleaved, with state per table (CDC-1 to CDC-5, JOIN-1, JOIN-2, SET-1, SET-3).

Events come in order of ``place``, and no two of a table have one place.  A table's state is what the merger of a running connector holds: the ranges scanned so far, the chunk
being read, and the changes that wait for a chunk.  Every change leaves the stream once, with its verdict, in whatever micro-batch
it is settled; what still waits at a cut point is in the state and nowhere else.

State is kept for slices of a table, not for tables: a slice is a stretch of keys, and an event of control (a chunk's begin or end, the snapshot's
completion) is handed to every slice that its range meets.  So a table with a third of all changes is judged by as many
tasks as it has slices.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..cdc.merge import BUFFER, EMIT, STALE, UNSCANNED

# Kinds of events.  A read is a row of the snapshot, which always passes.
CHANGE, BEGIN, END, COMPLETE = "change", "begin", "end", "complete"

EVENTS = "place long, kind string, table string, pk long, xid long, low long, high long, xmin long"
VERDICTS = "table string, place long, pk long, xid long, verdict string, settled_at long"

#: Rows that are handed on at once.
ROWS = 10_000
#: Bounds of an open range: keys are 64-bit whole numbers.
LEAST, MOST = -(2**63), 2**63 - 1


def control(chunks: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """EVENTS of ``chunks`` (table, begin, end, low, estimated, high, xmin; begin and end being places, a null end a chunk that is being read).

    ``completed`` has a row (table, place) for each table whose snapshot is over.
    """
    nothing = F.lit(None).cast("long")
    begin = chunks.select(F.col("begin").alias("place"), F.lit(BEGIN).alias("kind"), "table", nothing.alias("pk"), nothing.alias("xid"), "low", F.col("estimated").alias("high"), nothing.alias("xmin"))
    end = chunks.where(F.col("end").isNotNull()).select(F.col("end").alias("place"), F.lit(END).alias("kind"), "table", nothing.alias("pk"), nothing.alias("xid"), "low", "high", "xmin")
    out = begin.unionByName(end)
    if completed is None:
        return out
    over = completed.select("place", F.lit(COMPLETE).alias("kind"), "table", *[nothing.alias(c) for c in ("pk", "xid", "low", "high", "xmin")])
    return out.unionByName(over)


def changes(log: DataFrame) -> DataFrame:
    """EVENTS of a change log (place, table, pk, xid)."""
    nothing = F.lit(None).cast("long")
    return log.select("place", F.lit(CHANGE).alias("kind"), "table", "pk", "xid", nothing.alias("low"), nothing.alias("high"), nothing.alias("xmin"))


def sliced(events: DataFrame, cuts: list[int]) -> DataFrame:
    """``events`` with the ``slice`` of their table, cut after each of ``cuts``: a change's own one, and every one for events of control.

    Slices are (cut, next cut] of the key, so a chunk's range meets some, but its begin ends the chunk before in all of them.
    """
    places = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    own = F.size(F.filter(places, lambda c: c < F.col("pk")))
    slices = F.when(F.col("kind") == CHANGE, F.array(F.coalesce(own, F.lit(0)))).otherwise(F.sequence(F.lit(0), F.lit(len(cuts))))
    return events.withColumn("slice", F.explode(slices))


class Merger(StatefulProcessor):
    """Judges the changes of one slice of a table.

    ``ranges`` holds (low, high, xmin) by low, merged where neighbours have one xmin, so that it grows with the gaps and not with the chunks; ``open`` is the chunk
    being read; ``waiting`` has an entry for each change that waits, by place: a micro-batch writes what it adds, and reads what waits only where a chunk ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.phase = handle.getValueState("phase", "streaming boolean")
        self.open = handle.getValueState("open", "low long, high long")
        self.ranges = handle.getMapState("ranges", "low long", "high long, xmin long")
        self.waiting = handle.getMapState("waiting", "place long", "pk long, xid long")

    def close(self) -> None:
        pass

    def _ended(self, low: int, span: tuple[int, int, int] | None, fresh: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(place, pk, xid) of waiting changes in (low, span's high], or of all without a span; they wait no longer."""
        inside = lambda pk: span is None or low < pk <= span[1]
        for place in [p for p, (pk, _) in fresh.items() if inside(pk)]:
            yield (place, *fresh.pop(place))
        gone = [(p[0], *v) for p, v in self.waiting.iterator() if inside(v[0])] if self.waiting.exists() else []
        for place, pk, xid in gone:
            self.waiting.removeKey((place,))
            yield place, pk, xid

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        table = key[0]
        events = pd.concat(list(rows), ignore_index=True).sort_values("place", kind="stable")
        streaming = was_streaming = self.phase.exists() and bool(self.phase.get()[0])
        now = was_open = tuple(self.open.get()) if self.open.exists() else None
        held = sorted((low[0], *span) for low, span in self.ranges.iterator()) if self.ranges.exists() else []
        lows, old = [r[0] for r in held], {r[0]: r for r in held}
        fresh: dict[int, tuple[int, int]] = {}
        out: list[tuple] = []
        for place, kind, known, pk, xid, low, high, xmin in zip(*[events[c].tolist() for c in ("place", "kind", "known", "pk", "xid", "low", "high", "xmin")]):
            if kind == CHANGE:
                pk = pk if known else None
                at = bisect.bisect_left(lows, pk) - 1 if pk is not None else -1
                if streaming:
                    out.append((table, place, pk, xid, EMIT, place))
                elif at >= 0 and pk <= held[at][1]:
                    out.append((table, place, pk, xid, EMIT if xid >= held[at][2] else STALE, place))
                elif pk is not None and now is not None and now[0] < pk <= now[1]:
                    fresh[place] = (pk, xid)
                else:
                    out.append((table, place, pk, xid, UNSCANNED, place))
            elif kind == BEGIN:
                now = (low, high)
            elif kind == END and now is not None:
                span, now = (now[0], high, xmin), None
                out += [(table, p, k, x, EMIT if x >= span[2] else STALE, place) for p, k, x in self._ended(span[0], span, fresh)]
                at = bisect.bisect_left(lows, span[0])
                if at and held[at - 1][1] == span[0] and held[at - 1][2] == span[2]:  # a neighbour of the same xmin grows
                    held[at - 1] = (held[at - 1][0], *span[1:])
                else:
                    held.insert(at, span)
                    lows.insert(at, span[0])
            elif kind == COMPLETE:
                out += [(table, p, k, x, EMIT, place) for p, k, x in self._ended(LEAST, None, fresh)]
                held, lows, now, streaming = [], [], None, True
        for place, change in fresh.items():
            self.waiting.updateValue((place,), change)
        new = {r[0]: r for r in held}
        for low in old.keys() - new.keys():
            self.ranges.removeKey((low,))
        for low, span in new.items():
            if old.get(low) != span:
                self.ranges.updateValue((low,), span[1:])
        if now != was_open:
            self.open.update(now) if now is not None else self.open.clear()
        if streaming != was_streaming:
            self.phase.update((streaming,))
        for at in range(0, len(out), ROWS):
            yield pd.DataFrame(out[at : at + ROWS], columns=["table", "place", "pk", "xid", "verdict", "settled_at"]).astype({"pk": "Int64"})


def merged(events: DataFrame, cuts: list[int] = ()) -> DataFrame:
    """VERDICTS of a stream of EVENTS: one row for each change that is settled, at the place of the event that settled it.

    ``cuts`` are key values at which tables are cut into slices, say chunk boundaries; they are few, and those of one checkpoint stay the same.
    """
    # whole numbers with nulls would reach Python as floating-point ones
    nothing = F.lit(0).cast("long")
    whole = events.withColumns({
        "known": F.col("pk").isNotNull(), "low": F.coalesce("low", F.lit(LEAST)), "high": F.coalesce("high", F.lit(MOST)), "xid": F.coalesce("xid", nothing), "xmin": F.coalesce("xmin", nothing),
    })
    by = sliced(whole, list(cuts)).withColumn("pk", F.coalesce("pk", nothing)).groupBy("table", "slice")
    return by.transformWithStateInPandas(Merger(), VERDICTS, "append", "none")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """VERDICTS of changes that a stopped stream still holds, ``settled_at`` being null: read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    place, change = F.col("user_map_key.place"), F.col("user_map_value")
    return state.select(F.col("key.table").alias("table"), place.alias("place"), change["pk"].alias("pk"), change["xid"].alias("xid"), F.lit(BUFFER).alias("verdict"), F.lit(None).cast("long").alias("settled_at"))


def ranges(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(table, slice, low, high, xmin) of the ranges that a stopped stream knows as scanned, neighbours of one xmin being one."""
    state = spark.read.format("statestore").option("stateVarName", "ranges").load(checkpoint)
    return state.select("key.table", "key.slice", "user_map_key.low", "user_map_value.high", "user_map_value.xmin")
