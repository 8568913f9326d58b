"""Resume offsets from acknowledgements (AGG-3 to AGG-5, JOIN-6, SNK-2, SNK-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.numbering import ranked
from .wal import READ

SNAPSHOT, STREAMING = "snapshot", "streaming"


def completion(chunk_plan: DataFrame, acked: DataFrame) -> DataFrame:
    """(table, chunk_id, size, hi, acked, complete) of each chunk; ``acked`` has a row (table, chunk_id) per acknowledged read.

    Chunks are told apart by table and id, so that ids of different tables never mix.
    """
    n = acked.groupBy("table", "chunk_id").agg(F.count("*").alias("acked"))
    joined = chunk_plan.join(n, ["table", "chunk_id"], "left").withColumn("acked", F.coalesce("acked", F.lit(0).cast("bigint")))
    return joined.select("table", "chunk_id", "size", "hi", "acked", (F.col("acked") >= F.col("size")).alias("complete"))


def cursors(chunks: DataFrame) -> DataFrame:
    """(table, cursor): the key up to which all chunks are complete; null if the first one is pending.

    ``chunks`` has table, chunk_id, hi, complete.  The watermark is contiguous: a complete chunk after a pending one doesn't count.
    """
    first = chunks.groupBy("table").agg(F.min(F.when(~F.col("complete"), F.col("chunk_id"))).alias("_pending"))
    before = F.col("complete") & (F.col("_pending").isNull() | (F.col("chunk_id") < F.col("_pending")))
    joined = chunks.join(first, "table")
    return joined.groupBy("table").agg(F.max_by("hi", F.when(before, F.col("chunk_id"))).alias("cursor"))


def confirmed_lsn(acked: DataFrame, saved: int = 0) -> DataFrame:
    """One row: the greatest lsn of acknowledged changes (reads don't count), never below the ``saved`` one."""
    return acked.agg(F.greatest(F.lit(saved).cast("bigint"), F.max(F.when(F.col("op") != READ, F.col("lsn")))).alias("confirmed_lsn"))


def phases(chunks: DataFrame, scan_done: bool) -> DataFrame:
    """(table, pending, completed, phase): a table streams when its scan is over and no chunk is pending."""
    counted = chunks.groupBy("table").agg(F.count_if(~F.col("complete")).alias("pending"), F.count_if(F.col("complete")).alias("completed"))
    return counted.withColumn("phase", F.when(F.lit(scan_done) & (F.col("pending") == 0), STREAMING).otherwise(SNAPSHOT))


def coalesced(scanned: DataFrame, horizon: int | None = None) -> DataFrame:
    """(table, chunk_id, low, high, xmin) of ``scanned`` ranges, disjoint within a table, with neighbours of one xmin as one: as many rows as there are gaps.

    No change below ``horizon`` can come any more, if it is given, so ranges whose xmin isn't above it judge all alike and count as one class; its xmin is the horizon.
    Verdicts of changes that can come stay as they are. A range keeps the chunk id of its first one; empty ranges hold no key and are left out.

    A run's first range is one whose low end is no neighbour's high end, and its last one likewise, so runs are found without a window over a table; only their ends are
    numbered, dealt by ranges of the key, and the n-th first one belongs to the n-th last one.
    """
    level = F.col("xmin") if horizon is None else F.greatest("xmin", F.lit(horizon).cast("bigint"))
    own = scanned.where("low is null or high is null or high > low").select("table", "chunk_id", "low", "high", level.alias("xmin"))

    def without(here: str, there: str) -> DataFrame:
        """Ranges whose end ``here`` is the end ``there`` of no range of their table and xmin; open ends are nobody's."""
        other = own.select(F.col("table").alias("_table"), F.col("xmin").alias("_xmin"), F.col(there).alias("_at"))
        return own.join(other, (F.col("table") == F.col("_table")) & (F.col(here) == F.col("_at")) & F.col("xmin").eqNullSafe(F.col("_xmin")), "left_anti")

    firsts = ranked(without("low", "high").select("table", "chunk_id", "low"), ["table"], "low", "_run")
    lasts = ranked(without("high", "low").select("table", F.col("low").alias("_low"), "high", "xmin"), ["table"], "_low", "_run").drop("_low")
    return firsts.join(lasts, ["table", "_run"]).select("table", "chunk_id", "low", "high", "xmin")


def state(slot: str, cursor: DataFrame, lsn: DataFrame, phase: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """(slot, state): a connector's state as JSON, from one table's cursor and phase and the confirmed lsn (SNK-2).

    Scanned ranges, if given, are kept, so that a restart judges changes of scanned rows; there is one per chunk.
    """
    row = cursor.join(phase, "table").withColumn("confirmed_lsn", lsn.select("confirmed_lsn").scalar())
    kept = F.array().cast("array<struct<table:string,low:bigint,high:bigint,xmin:bigint>>")
    if scanned is not None:
        row = row.join(scanned.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("table", "low", "high", "xmin"))).alias("_ranges")), "table", "left")
        kept = F.coalesce("_ranges", kept)
    fields = F.struct("phase", F.lit(slot).alias("slot_name"), "confirmed_lsn", F.col("table").alias("current_snapshot_table"), F.col("cursor").alias("snapshot_cursor"), kept.alias("scanned_pk_ranges"))
    return row.select(F.lit(slot).alias("slot"), F.to_json(fields).alias("state"))
