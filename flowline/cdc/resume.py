"""Saving a connector's progress and going on from it (SCAN-4, SNK-2, SNK-4, UDF-6).

A state is small JSON in the offset store; the scanned ranges, as many as there are gaps, are Parquet beside it, written before the JSON that names them. So a
state that can be read has its ranges, and a save that failed half-way leaves the one before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import canonical_uuid
from ..sources.offset_store import OffsetStore
from . import snapshot
from .offsets import SNAPSHOT, STREAMING, coalesced


@dataclass(frozen=True)
class Saved:
    """What a connector goes on from.

    ``tables`` are (name, key column) in the order in which they are scanned; ``table`` is the one under way and ``cursor`` the key up to which its reads are acknowledged, null where none is.
    ``ranges`` has (table, chunk_id, low, high, xmin) of what has been scanned, one DataFrame for each type of key.
    """

    tables: list[tuple[str, str]]
    phase: str = SNAPSHOT
    confirmed_lsn: int = 0
    table: str | None = None
    cursor: int | str | None = None
    ranges: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        names = [name for name, _ in self.tables]
        if self.phase not in (SNAPSHOT, STREAMING):
            raise ValueError(f"unknown phase: {self.phase}")
        if len(set(names)) < len(names):
            raise ValueError("a table is named twice")
        if self.table is not None and self.table not in names:
            raise ValueError(f"the table under way is none of the snapshot's: {self.table}")

    def done(self) -> list[str]:
        """Tables that are scanned and acknowledged whole."""
        names = [name for name, _ in self.tables]
        return names if self.phase == STREAMING else names[: names.index(self.table)] if self.table is not None else []


def _ranges_root(root: str, slot: str) -> str:
    return f"{root.rstrip('/')}/ranges-{slot.encode().hex()}"


def save(spark: SparkSession, root: str, slot: str, saved: Saved, horizon: int | None = None) -> int:
    """Keeps ``saved`` as the slot's next version in the store at ``root``; ranges are coalesced, up to ``horizon`` as :func:`coalesced` has it.

    Once streaming, every change is emitted, so no ranges are kept.
    """
    paths = []
    for ranges in saved.ranges if saved.phase == SNAPSHOT else []:
        path = f"{_ranges_root(root, slot)}/{uuid.uuid4().hex}"
        coalesced(ranges, horizon).write.parquet(path)
        paths.append(path)
    whole = isinstance(saved.cursor, int)
    state = {
        "phase": saved.phase, "slot_name": slot, "confirmed_lsn": saved.confirmed_lsn, "snapshot_tables": [{"name": n, "pk_column": c} for n, c in saved.tables],
        "current_snapshot_table": saved.table, "snapshot_cursor": saved.cursor if whole else None, "snapshot_cursor_uuid": None if whole else saved.cursor, "range_files": paths,
    }
    return OffsetStore(spark, root).save(slot, json.dumps(state))


def load(spark: SparkSession, root: str, slot: str) -> Saved | None:
    """The slot's newest state, or None.

    Ranges beyond the cursor of the table under way, and of tables after it, belong to reads that may not have been acknowledged. Those chunks
    are read again, so such ranges are left out, and one that holds the cursor ends there.
    """
    text = OffsetStore(spark, root).load(slot)
    if text is None:
        return None
    state = json.loads(text)
    tables = [(t["name"], t["pk_column"]) for t in state["snapshot_tables"]]
    whole = state["snapshot_cursor"]
    bare = Saved(tables, state["phase"], state["confirmed_lsn"], state["current_snapshot_table"], whole if whole is not None else state["snapshot_cursor_uuid"])
    ranges = [_acknowledged(spark.read.parquet(p), bare) for p in state["range_files"]]
    return Saved(bare.tables, bare.phase, bare.confirmed_lsn, bare.table, bare.cursor, ranges)


def _acknowledged(ranges: DataFrame, saved: Saved) -> DataFrame:
    over = F.col("table").isin(saved.done())
    if saved.cursor is None or (dict(ranges.dtypes)["low"] == "string") != isinstance(saved.cursor, str):
        return ranges.where(over)
    cursor = F.lit(saved.cursor)
    begun = (F.col("table") == saved.table) & (F.col("low").isNull() | (F.col("low") < cursor))
    return ranges.where(over | begun).withColumn("high", F.when(over, F.col("high")).otherwise(F.least("high", cursor)))


def rest(saved: Saved, rows: dict[str, DataFrame], size: int = snapshot.CHUNK_SIZE) -> list[DataFrame]:
    """(ordinal, table, pk, chunk_id) of what is still to be scanned of ``rows`` by table, one DataFrame for each type of key; none once streaming.

    Tables are scanned in the state's order. Chunks are numbered from 0 after the cursor, so they are those of this run.
    """
    out: dict[bool, DataFrame] = {}
    done = saved.done()
    for ordinal, (name, column) in enumerate(saved.tables):
        if name in done:
            continue
        if name not in rows:
            raise ValueError(f"no rows are given for {name}")
        left, text = rows[name], dict(rows[name].dtypes)[column] == "string"
        if name == saved.table and saved.cursor is not None:
            left = left.where((canonical_uuid(F.col(column)) if text else F.col(column)) > F.lit(saved.cursor))
        one = snapshot.chunks(left.select(column), column, name, size).select(F.lit(ordinal).alias("ordinal"), "table", "pk", "chunk_id")
        out[text] = out[text].unionByName(one) if text in out else one
    return list(out.values())


def scanned(saved: Saved, read: DataFrame, xmin: Column) -> DataFrame:
    """(table, chunk_id, low, high, xmin) of all that is scanned once ``read``, rows of :func:`rest` of one type of key, have been read as well.

    The first chunk of the table under way begins at the cursor, where the state's ranges end.
    """
    told = snapshot.ranges(snapshot.plan(read), xmin)
    kind = dict(told.dtypes)["low"]
    if saved.cursor is not None and (kind == "string") == isinstance(saved.cursor, str):
        told = told.withColumn("low", F.when((F.col("table") == saved.table) & F.col("low").isNull(), F.lit(saved.cursor)).otherwise(F.col("low")))
    for before in saved.ranges:
        if dict(before.dtypes)["low"] == kind:
            told = told.unionByName(before)
    return told


def compact(spark: SparkSession, root: str, slot: str) -> None:
    """Removes all states of the slot but the newest, and ranges that it doesn't name; the slot's one connector calls it, between saves."""
    store = OffsetStore(spark, root)
    store.compact(slot)
    text = store.load(slot)
    named = {p.rsplit("/", 1)[1] for p in json.loads(text)["range_files"]} if text else set()
    folder = spark._jvm.org.apache.hadoop.fs.Path(_ranges_root(root, slot))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files.listStatus(folder) if files.exists(folder) else []:
        if f.getPath().getName() not in named:
            files.delete(f.getPath(), True)
