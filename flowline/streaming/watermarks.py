"""Low watermarks as a stream: how far acknowledgements reach without a gap, whatever order they come in (AGG-3 to AGG-5, JOIN-6, SNK-2).

What is to be acknowledged has positions 0, 1, 2, ... within a name: the rows of a table's scan, or the changes emitted for a slot. An acknowledgement covers
positions [low, high), and may come more than once. State holds the acknowledged stretches, neighbours being one, so it grows with the gaps and not with what is done,
and by a bit for each position around them at most.

A name's positions are dealt to lanes by blocks in turn, so that one with a third of all acknowledgements is followed by as many tasks as there are lanes. Each lane tells the
first position that it misses, and the least of these is where the name stands. Chunk ends and LSNs up to there are safe to resume from; the greatest acknowledged
one isn't, as it skips what failed before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ACKS = "name string, low long, high long"
REACHED = "name string, lane int, missing long, gaps long"
GATHERED = "name string, lane int, stretches binary"

#: Positions of one block, and lanes to which blocks are dealt; both stay the same for one checkpoint.
BLOCK, LANES = 4096, 8
#: Places of a lane whose stretches are one entry of its state, and acknowledgements that are sorted at once at least.
CELL, ROWS = 1024, 100_000
#: Cells whose bits are spread out at once, and stretches of a lane that are one row of GATHERED at most.
SPREAD, ROW = 4096, 128
#: An entry of the state: how many stretches begin in the cell, the first one, where the last one ends, and, if they are several, a bit for each place of the cell, set where one covers it.
ENTRY = "n int, low long, high long, reach long, bits binary"


def laned(acks: DataFrame, block: int, lanes: int) -> DataFrame:
    """ACKS cut at the ends of blocks, with their lane; low and high are places in the lane, where its blocks follow one another.

    Empty and negative stretches, and those without a name or bound, say nothing and are left out.
    """
    usable = acks.where("name is not null and low >= 0 and high > low")
    cut = usable.withColumn("_block", F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")))
    first = F.expr(f"_block div {lanes}") * block
    inside = lambda c: first + c - F.col("_block") * block
    return cut.select(
        "name", F.expr(f"cast(_block % {lanes} as int)").alias("lane"), inside(F.greatest("low", F.col("_block") * block)).alias("low"),
        inside(F.least("high", (F.col("_block") + 1) * block)).alias("high"),
    )


def joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [low, high) as disjoint ones by low; those that overlap or touch are one."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]])[: len(low)])
    return low[first], reach[np.append(first[1:], len(low))[: len(first)] - 1]


def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GATHERED of acknowledgements by lane: those of a batch are joined, and many go to their lane as one row, as Spark hands over rows of stateful Python one by one."""
    for part in parts:
        name = part.column("name").dictionary_encode()
        lane, low, high = (part.column(c).to_numpy() for c in ("lane", "low", "high"))
        order = np.lexsort((low, lane, name.indices.to_numpy()))
        of, lane, low, high = name.indices.to_numpy()[order], lane[order], low[order], high[order]
        ends = np.flatnonzero((np.diff(of) != 0) | (np.diff(lane) != 0)) + 1
        at, rows = [], []
        for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), len(of)] if len(of) else []):
            lows, highs = joined(low[begin:end], high[begin:end])
            for k in range(0, len(lows), ROW):
                at.append(begin)
                rows.append(np.concatenate([lows[k : k + ROW], highs[k : k + ROW]]).astype("<i8").tobytes())
        at = np.array(at, np.int64)
        yield pa.RecordBatch.from_arrays([name.dictionary.take(pa.array(of[at])), pa.array(lane[at]), pa.array(rows, pa.binary())], ["name", "lane", "stretches"])


def spread(rows: pd.Series) -> np.ndarray:
    """Both ends of the stretches of GATHERED rows, as two lines."""
    return np.concatenate([np.empty((2, 0), np.int64), *[np.frombuffer(r, "<i8").reshape(2, -1) for r in rows]], axis=1)


def packed(low: np.ndarray, high: np.ndarray) -> dict[int, tuple]:
    """{cell: ENTRY} of disjoint stretches by low, none touching the next."""
    cells, at, n = np.unique(low // CELL, return_index=True, return_counts=True)
    several, own = np.flatnonzero(n > 1), np.repeat(n > 1, n)
    lows, highs, ends = low[own], high[own], np.append(0, np.cumsum(n[several]))
    bits: list[bytes | None] = [None] * len(cells)
    for k in range(0, len(several), SPREAD):
        part = several[k : k + SPREAD]
        of, row = slice(ends[k], ends[k + len(part)]), np.repeat(np.arange(len(part)), n[part])
        edge = np.zeros((len(part), CELL + 1), np.int8)
        edge[row, lows[of] % CELL] = 1
        edge[row, np.minimum(highs[of] - lows[of] // CELL * CELL, CELL)] = -1
        for cell, line in zip(part.tolist(), np.packbits(np.cumsum(edge[:, :CELL], axis=1, dtype=np.int8), axis=1)):
            bits[cell] = line.tobytes()
    return dict(zip(cells.tolist(), zip(n.tolist(), low[at].tolist(), high[at].tolist(), high[at + n - 1].tolist(), bits)))


def unpacked(entries: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``packed`` entries, by low."""
    one = [e for e in entries.values() if e[4] is None]
    several = [cell for cell, e in entries.items() if e[4] is not None]
    lows, highs = [np.array([e[1] for e in one], np.int64)], [np.array([e[2] for e in one], np.int64)]
    for k in range(0, len(several), SPREAD):
        part = several[k : k + SPREAD]
        line = np.frombuffer(b"".join(entries[cell][4] for cell in part), np.uint8).reshape(len(part), CELL // 8)
        edge = np.diff(np.unpackbits(line, axis=1).view(np.int8), axis=1, prepend=0, append=0).astype(np.int8)
        row, first = np.nonzero(edge == 1)
        start = np.array(part, np.int64)[row] * CELL
        end = start + np.nonzero(edge == -1)[1]
        end[np.append(np.flatnonzero(np.diff(row)), len(row) - 1)] = [entries[cell][3] for cell in part]
        lows.append(start + first)
        highs.append(end)
    low, high = np.concatenate(lows), np.concatenate(highs)
    order = np.argsort(low, kind="stable")
    return low[order], high[order]


class Tracker(StatefulProcessor):
    """Keeps the acknowledged stretches of one lane, those that begin in one cell of ``CELL`` positions as one entry of a list.

    An entry takes a bit for each place of its cell at most, however many gaps it has, and a lane's list is read and written at once: a call of Spark's for each
    entry that changed took ten times as long, and acknowledgements out of order change most.
    """

    def __init__(self, block: int, lanes: int):
        self.block, self.lanes = block, lanes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getListState("done", f"cell long, {ENTRY}")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = {cell: (*e[:4], e[4] and bytes(e[4])) for cell, *e in self.done.get()} if self.done.exists() else {}
        low, high, fresh, n = *unpacked(held), [], 0
        for part in rows:  # what has come is joined to what is known whenever it is as much, so that each stretch is sorted few times
            fresh.append(spread(part["stretches"]))
            n += fresh[-1].shape[1]
            if n > max(len(low), ROWS):
                low, high = joined(np.concatenate([low, *[f[0] for f in fresh]]), np.concatenate([high, *[f[1] for f in fresh]]))
                fresh, n = [], 0
        low, high = joined(np.concatenate([low, *[f[0] for f in fresh]]), np.concatenate([high, *[f[1] for f in fresh]]))
        new = packed(low, high)
        if new != held:
            self.done.put([(cell, *entry) for cell, entry in new.items()])
        name, lane = key
        begun = bool(len(low)) and low[0] == 0
        place = int(high[0]) if begun else 0
        missing = (place // self.block * self.lanes + int(lane)) * self.block + place % self.block
        yield pd.DataFrame([(name, int(lane), missing, len(low) - begun)], columns=["name", "lane", "missing", "gaps"])


def tracked(acks: DataFrame, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """REACHED of a stream of ACKS: for each lane with news, the first position it misses and the stretches beyond that are acknowledged."""
    return laned(acks, block, lanes).mapInArrow(gathered, GATHERED).groupBy("name", "lane").transformWithStateInPandas(Tracker(block, lanes), REACHED, "update", "none")


def reached(told: DataFrame, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """(name, upto): every position before ``upto`` is acknowledged, by all REACHED rows told so far; those told before are outdone, so replays do no harm.

    A lane that told nothing misses its first position. There is one map entry for each lane of a name.
    """
    each = told.groupBy("name", "lane").agg(F.max("missing").alias("missing"))
    known = each.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("lane", "missing"))).alias("_known"))
    every = F.sequence(F.lit(0), F.lit(lanes - 1))
    return known.select("name", F.array_min(F.transform(every, lambda lane: F.coalesce(F.col("_known")[lane], lane.cast("long") * block))).alias("upto"))


def kept(spark: SparkSession, checkpoint: str, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """REACHED as a stopped stream's state has it."""
    state = spark.read.format("statestore").option("stateVarName", "done").load(checkpoint)
    first = F.when(F.col("list_element.low") == 0, F.col("list_element.high"))
    each = state.select(F.col("key.name").alias("name"), F.col("key.lane").alias("lane"), first.alias("_first"), F.col("list_element.n").cast("long").alias("_n"))
    found = each.groupBy("name", "lane").agg(F.coalesce(F.max("_first"), F.lit(0)).alias("_place"), (F.sum("_n") - F.count("_first")).alias("gaps"))
    missing = (F.expr(f"_place div {block}") * lanes + F.col("lane")) * block + F.col("_place") % block
    return found.select("name", "lane", missing.cast("long").alias("missing"), "gaps")


def safe(upto: DataFrame, marks: DataFrame) -> DataFrame:
    """(name, upto, mark): the last of ``marks`` (name, end, mark) of which every position before ``end`` is acknowledged; null if none is.

    Marks are chunks' last keys, or changes' LSNs. Names are joined by broadcast only if Spark's own measure of them allows; per name one mark is kept in partial aggregates.
    """
    met = marks.join(upto, "name").where("end <= upto").groupBy("name").agg(F.max_by("mark", "end").alias("mark"))
    return upto.join(met, "name", "left").select("name", "upto", "mark")
